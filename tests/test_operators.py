"""Hand-built bars and signals, and properties that must hold on any input."""

import datetime
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlattice.functions import scalars as sc
from barlattice.operators import adjust, structure as st, execution as ex, features as fx, joins as jn, ledger as lg, patterns as pt, ranks as rk, statistics as stt
from barlattice.sources import files, panel as P
from barlattice.streaming import late

DAY = datetime.date(2026, 8, 27)
BARS = "symbol string, date date, open double, high double, low double, close double, volume double, turnover double"


def flat(n=260, symbol="60000001", last=None):
    """A flat history that ends on DAY, its last bar as given."""
    rows = [(symbol, DAY - datetime.timedelta(days=n - 1 - i), 10.0, 10.2, 9.5, 10.0, 100.0, 1000.0) for i in range(n)]
    if last:
        rows[-1] = (symbol, DAY, *last)
    return rows


def platform(spark, rows):
    df = pt.platform_match(fx.platform_features(spark.createDataFrame(rows, BARS)))
    return df.where(F.col("date") == F.lit(DAY)).first()


def test_platform_match_and_boundaries(spark):
    hit = platform(spark, flat(last=(10.0, 10.5, 10.0, 10.4, 200.0, 2000.0)))
    assert hit.matched and hit.failed_conditions == [] and len(hit.matched_conditions) == 5
    assert platform(spark, flat(last=(10.0, 10.5, 10.0, 10.4, 180.0, 2000.0))).matched  # exactly 1.8
    low = platform(spark, flat(last=(10.0, 10.5, 10.0, 10.4, 179.0, 2000.0)))
    assert not low.matched and low.failed_conditions == ["VOLUME_EXPANSION"]
    assert not platform(spark, flat(119, last=(10.0, 10.5, 10.0, 10.4, 200.0, 2000.0))).matched


def random_panel(seed=1, symbols=3, n=150):
    r = random.Random(seed)
    rows = []
    for s in range(symbols):
        c = 10.0
        for i in range(n):
            o = c
            c = max(1.0, c * (1 + r.uniform(-0.05, 0.05)))
            rows.append((f"60{s:06d}", datetime.date(2020, 1, 1) + datetime.timedelta(days=i), o, max(o, c) * 1.01, min(o, c) * 0.99, c, r.uniform(50, 300), r.uniform(1e3, 1e4)))
    return rows


@pytest.mark.parametrize("function", [fx.platform_features, fx.returns_and_risk, fx.compression_features, fx.reversal_features, fx.trend_features, fx.geometry, fx.relative_volume, fx.first_breakout])
def test_no_look_ahead_and_order(spark, function):
    rows = random_panel()
    cut = datetime.date(2020, 4, 30)
    early = [r for r in rows if r[1] <= cut]

    def result(x):
        return {(r.symbol, r.date): str(r) for r in function(spark.createDataFrame(x, BARS)).where(F.col("date") <= F.lit(cut)).collect()}

    whole = result(rows)
    assert whole and result(early) == whole
    random.Random(2).shuffle(rows)
    assert result(rows) == whole


def test_features_by_hand(spark):
    rows = [r for r in random_panel(3, 1, 130)]
    r = fx.platform_features(spark.createDataFrame(rows, BARS)).orderBy(F.col("date").desc()).first()
    c, h, l, v = (np.array([x[i] for x in rows]) for i in (5, 3, 4, 6))
    assert np.isclose(r.ma20, c[-20:].mean()) and np.isclose(r.vma20_prev, v[-21:-1].mean()) and np.isclose(r.chg10, (c[-1] / c[-11] - 1) * 100)
    assert np.isclose(r.plat_range, (h[-61:-1].max() - l[-61:-1].min()) / l[-61:-1].min()) and np.isclose(r.prev60_hi_c, c[-61:-1].max())
    step = np.diff(c)[-20:]
    assert np.isclose(r.ud_ratio, v[-20:][step > 0].mean() / v[-20:][step < 0].mean())
    assert np.isclose(r.vol_bar_lo, l[-10:][v[-10:].argmax()])


EVENT = "symbol string, ex_date date, dividend double, bonus double, allotment double, allotment_price double"


def test_adjustment(spark):
    rows = flat(10)
    ex_date = DAY - datetime.timedelta(days=4)
    events = spark.createDataFrame([("60000001", ex_date, 0.5, 0.1, 0.0, 0.0), ("60000001", DAY + datetime.timedelta(days=1), 5.0, 0.0, 0.0, 0.0)], EVENT)
    out = {r.date: r for r in adjust.anchor_adjusted(spark.createDataFrame(rows, BARS), events, F.lit(DAY)).collect()}
    assert np.isclose(out[ex_date - datetime.timedelta(days=1)].close, (10 - 0.5) / 1.1) and out[ex_date].close == 10.0
    assert {r.volume for r in out.values()} == {100.0}
    before = {r.date: r.close for r in adjust.anchor_adjusted(spark.createDataFrame(rows, BARS), events, F.lit(ex_date - datetime.timedelta(days=1))).collect()}
    assert set(before.values()) == {10.0}  # not known yet


PATH = "signal_id string, step long, trigger double, stop double, target double, b_open double, b_high double, b_low double, b_close double"


def replay(spark, bars, **options):
    rows = [("s", i + 1, 100.0, 95.0, 110.0, *(b or (None,) * 4)) for i, b in enumerate(bars)]
    return ex.replay(spark.createDataFrame(rows, PATH), **options).first()


CALM = (99.0, 99.5, 98.0, 99.0)
UP = (99.0, 101.0, 98.0, 100.5)


def test_replay_cases(spark):
    n = 11
    assert replay(spark, [CALM] * n).status == "NOT_TRIGGERED"
    r = replay(spark, [(99.0, 112.0, 90.0, 100.0)] + [CALM] * 10)  # both touched on the entry day: not sellable yet
    assert r.entry_step == 1 and r.status == "EXIT_TIME" and r.exit_price == 99.0
    r = replay(spark, [UP, (94.0, 96.0, 93.0, 95.0)] + [CALM] * 9)
    assert (r.status, r.exit_price, r.exit_step) == ("EXIT_STOP_GAP", 94.0, 2)
    r = replay(spark, [UP, (100.0, 111.0, 99.0, 108.0)] + [CALM] * 9)
    assert (r.status, r.exit_price) == ("EXIT_TARGET", 110.0)
    r = replay(spark, [UP, (100.0, 111.0, 94.0, 108.0)] + [CALM] * 9)
    assert r.status == "EXIT_AMBIGUOUS" and r.exit_price is None and r.return_pct is None
    r = replay(spark, [CALM, None] + [UP] * 9)
    assert r.status == "UNVERIFIED" and r.entry_step is None
    r = replay(spark, [CALM] * 9 + [UP, (101.0, 102.0, 100.0, 101.5)])  # entered on the tenth: out at the next open
    assert (r.entry_step, r.status, r.exit_step, r.exit_price) == (10, "EXIT_TIME", 11, 101.0)
    r = replay(spark, [(103.0, 104.0, 102.0, 103.0)] + [CALM] * 10)
    assert r.entry_price == 103.0
    r = replay(spark, [(103.0, 104.0, 102.0, 103.0), (94.0, 96.0, 93.0, 95.0)] + [CALM] * 9, gap_fills=False, time_exit=False)
    assert (r.entry_price, r.exit_price) == (100.0, 95.0)


def test_ranks(spark):
    df = spark.createDataFrame([("d", s, float(v)) for s, v in zip("abcdef", [1, 2, 2, 3, 3, 3])], "date string, symbol string, v double")
    got = {r.symbol: r.r for r in df.select("symbol", rk.average_rank(["date"], "v").alias("r")).collect()}
    assert got == {"a": 1.0, "b": 2.5, "c": 2.5, "d": 5.0, "e": 5.0, "f": 5.0}
    weights = {r.symbol: round(r.weight, 9) for r in rk.boundary_weights(df, ["date"], "v", 2).collect()}
    assert weights == {"a": 0, "b": 0, "c": 0, "d": round(1 / 3, 9), "e": round(1 / 3, 9), "f": round(1 / 3, 9)}
    top = {r.symbol for r in rk.top_fraction(df, ["date"], "v", "symbol", 0.5).where("selected").collect()}
    assert top == {"d", "e", "f"}
    runs = {(r.start, r.length) for r in rk.run_lengths(spark.createDataFrame([("k", p) for p in (1, 2, 3, 7, 9, 10)], "k string, p long"), ["k"], "p").collect()}
    assert runs == {(1, 3), (7, 1), (9, 2)}


def test_pareto_fronts_of_two_values(spark):
    r = random.Random(5)
    rows = [("d", str(i), float(r.randint(0, 8)), float(r.randint(0, 8))) for i in range(40)]

    def beats(a, b):
        return a[2] >= b[2] and a[3] <= b[3] and (a[2] > b[2] or a[3] < b[3])

    df = spark.createDataFrame(rows, "d string, name string, h double, l double")
    left, want, front = list(rows), {}, 1
    while left and front <= 3:
        first = [b for b in left if not any(beats(a, b) for a in left)]
        want |= {b[1]: front for b in first}
        left = [b for b in left if b not in first]
        front += 1
    want |= {b[1]: None for b in left}
    assert {x.name: x.front for x in rk.pareto_fronts(df, "d", "h", "l", "name").collect()} == want


def brute_structure(bars, rule):
    """The same search over the whole history of one symbol, bar by bar."""
    low, high = [b[4] for b in bars], [b[3] for b in bars]
    out = {}
    for t in range(max(rule.slow, rule.reach + 2) - 1, len(bars)):
        def pivots(v, best):
            return [i for i in range(rule.radius, t - rule.radius) if v[i] == best(v[i - rule.radius : i + rule.radius + 1])]

        lows, highs = pivots(low, min), pivots(high, max)
        for b in reversed(lows):
            for a in reversed([i for i in lows if i < b]):
                if b - a < rule.apart or low[b] <= low[a] or t in out:
                    continue
                peaks, rebounds = [i for i in highs if i < a], [i for i in highs if i > b]
                if not peaks or not rebounds or t - peaks[-1] > rule.reach:
                    continue
                depth = (high[peaks[-1]] - min(low[peaks[-1] + 1 : t])) / high[peaks[-1]]
                size = (high[rebounds[-1]] - low[b]) / low[b]
                if rule.depth[0] <= depth <= rule.depth[1] and rule.rebound[0] <= size <= rule.rebound[1]:
                    out[t] = (peaks[-1] + 1, a + 1, b + 1, rebounds[-1] + 1)
    return out


@pytest.mark.parametrize("rule", [st.BALANCED, st.CONSERVATIVE])
def test_pullback_structures(spark, rule):
    rows = random_panel(7, 2, 200)
    got = {(r.symbol, r.rn - 1): (r.peak_rn, r.rn1, r.rn2, r.rebound_rn) for r in st.pullback_structures(P.numbered(spark.createDataFrame(rows, BARS)), rule).collect()}
    want = {}
    for s in {r[0] for r in rows}:
        want |= {(s, t): v for t, v in brute_structure([r for r in rows if r[0] == s], rule).items()}
    assert got == want and got


def test_exit_states(spark):
    calm, push = (10.0, 10.2, 9.8, 10.1), (10.0, 11.0, 9.9, 10.2)
    bars = [calm, push, calm, push, (9.5, 9.6, 8.0, 8.5)]
    rows = [("k", i + 1, 10.0, 11.0, 9.0, *b) for i, b in enumerate(bars)]
    x = spark.createDataFrame(rows, "key string, step long, entry double, peak double, floor double, open double, high double, low double, close double")
    states = {r.step: r.exit_state for r in st.exit_states(x).collect()}
    assert states == {2: "FIRST_RESISTANCE_REJECTION_WARNING", 3: "HOLD_OR_REOBSERVE", 4: "EARLY_PROFIT_TAKING_CANDIDATE", 5: "KEY_SUPPORT_BREAK"}


def test_cooldown(spark):
    df = spark.createDataFrame([("a", p) for p in (1, 5, 11, 12, 13, 22, 23, 40)] + [("b", 3)], "k string, p long")
    assert {(r.k, r.p) for r in pt.cooldown(df, "k", "p").collect()} == {("a", 1), ("a", 12), ("a", 23), ("a", 40), ("b", 3)}


def test_asof(spark):
    right = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y")], "k string, w long, v string")
    left = spark.createDataFrame([("a", 0), ("a", 1), ("a", 4), ("a", 9), ("b", 9)], "k string, t long")
    assert {(r.k, r.t, r.v) for r in jn.asof(left, right, "k", "t", "w", ["v"]).collect()} == {("a", 0, None), ("a", 1, "x"), ("a", 4, "x"), ("a", 9, "y"), ("b", 9, None)}


def test_block_bootstrap_repeats(spark):
    rows = [("k", i, float(i % 7)) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, o long, v double")
    a, b = (stt.moving_block_interval(df.repartition(n), ["k"], "o", "v", repetitions=500).first() for n in (1, 3))
    assert a == b and a.low <= np.mean([r[2] for r in rows]) <= a.high


def test_scalars(spark):
    df = spark.createDataFrame([("sh600519",), ("600519.SH",), ("1",), ("abc",), (None,)], "x string")
    assert [r[0] for r in df.select(sc.code_only(F.col("x"))).collect()] == ["600519", "600519", "000001", None, None]
    dates = spark.createDataFrame([("2026-01-02",), ("20260102",), ("2026/01/02",), ("20261399",)], "x string")
    assert [str(r[0]) for r in dates.select(sc.canonical_date(F.col("x"))).collect()] == ["2026-01-02", "2026-01-02", "None", "None"]
    names = spark.createDataFrame([("*ST ABC",), ("STABC",), ("st 甲",), ("甲ST",)], "x string")
    assert [r[0] for r in names.select(sc.is_special_treatment(F.col("x"))).collect()] == [True, False, True, False]


def test_sources(spark, tmp_path):
    raw = spark.createDataFrame([("600000.SH", 1577836800000, 1.0, 2.0, 0.5, 1.5, 10.0, 20.0)], "thscode string, date_ms long, open_price double, high_price double, low_price double, close_price double, volume double, turnover double")
    raw.write.parquet(str(tmp_path / "raw"))
    assert str(files.read_bars(spark, str(tmp_path / "raw")).first().date) == "2020-01-01"
    df = spark.createDataFrame([(1, DAY), (2, DAY)], "v int, signal_date date")
    files.write_by_date(df, str(tmp_path / "out"))
    files.write_by_date(df.limit(1), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    files.write_lines(df, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    twice = spark.createDataFrame([('{"code":0,"data":{"item":[{"date":"2020-01-01","close":1,"volume":2}]}}',)] * 2, "payload string")
    with pytest.raises(Exception, match="index date twice"):
        files.index_from_payloads(twice).collect()


def test_stream_drops_late_rows(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string, value double"
    source = tmp_path / "in"
    t = datetime.datetime
    for part in ([(1, t(2024, 1, 1, 1), "a", 1.0), (1, t(2024, 1, 1, 1), "a", 1.0)], [(2, t(2024, 1, 5), "a", 2.0)], [(3, t(2024, 1, 1, 2), "a", 4.0), (4, t(2024, 1, 9), "a", 8.0)], [(5, t(2024, 1, 12), "a", 0.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = late.windowed_activity(spark.readStream.schema(schema).parquet(str(source)))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    out = {str(r.start)[:10]: (r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out["2024-01-01"] == (1, 1.0)  # the late row of that day was dropped, the repeat counted once


@pytest.mark.parametrize("n", [1, 20, 33, 34, 150])
def test_joint_top_percent_of_few_rows(spark, monkeypatch, n):
    from barlattice.plans import q_statistics as q

    df = spark.createDataFrame([("s", DAY - datetime.timedelta(days=i), float(n - i), float(n - i), 0.0) for i in range(n)], "symbol string, date date, rv double, turnover double, ret10 double")
    monkeypatch.setattr(q, "bin_inputs", lambda spark, d: df)
    assert sorted(r.rv for r in q.joint_top_percent(spark, "").collect()) == [float(n - i) for i in range(-(-n // 100))][::-1]


def test_outcome_metrics(spark):
    r = random.Random(8)
    rows = [(h, y, r.choice([0.0, 1.5, -2.0, r.gauss(0, 3)]), abs(r.gauss(0, 2)), -abs(r.gauss(0, 2))) for h in (1, 5) for y in ("2024", "2025") for _ in range(r.randint(5, 40))] + [(9, "2025", 1.0, None, -1.0), (10, "2025", 0.0, 1.0, None)]
    df = spark.createDataFrame(rows, "horizon int, period string, ret double, mfe double, mae double")
    got = {(x.horizon, x.period): x for x in stt.outcome_metrics(df, "horizon", "period").collect()}
    assert set(got) == {(h, p) for h, y, *_ in rows for p in (y, "ALL")}
    for (h, p), x in got.items():
        own = [z for z in rows if z[0] == h and p in (z[1], "ALL")]
        ret = [z[2] for z in own]
        gains, rest = [v for v in ret if v > 0], [v for v in ret if v <= 0]
        mean = statistics.fmean(ret)
        expectancy = len(gains) / len(ret) * statistics.fmean(gains) + len(rest) / len(ret) * statistics.fmean(rest) if gains and rest else mean
        medians = [statistics.median(v) if (v := [z[i] for z in own if z[i] is not None]) else None for i in (3, 4)]
        assert (x.sample_count, x.positive_count, x.non_positive_count) == (len(ret), len(gains), len(rest))
        assert math.isclose(x.expectancy, expectancy, abs_tol=1e-9) and math.isclose(x.mean_return, mean, abs_tol=1e-9) and (x.min_return, x.max_return) == (min(ret), max(ret))
        for a, b in zip((x.median_mfe, x.median_mae), medians):
            assert a is b is None or math.isclose(a, b, abs_tol=1e-9)


def test_exit_states_by_price_and_by_volume(spark):
    """Two failed pushes above the entry: profit is taken by price; by price and volume only if the second one stalls."""
    push, calm, broken = (11.0, 11.0, 10.0, 10.2), (10.0, 10.5, 9.8, 10.2), (9.0, 9.2, 8.0, 8.5)
    paths = {"a": [(calm, False), (push, False), (push, True)], "b": [(calm, False), (push, True), (push, False)], "c": [(calm, False), (calm, True), (broken, True)], "d": [(push, True), (push, True)]}
    rows = [(k, i + 1, 10.0, 11.0, 9.0, *bar, stall) for k, own in paths.items() for i, (bar, stall) in enumerate(own)]
    df = spark.createDataFrame(rows, "key string, step int, entry double, peak double, floor double, open double, high double, low double, close double, stalls boolean")

    def states(**more):
        return {(r.key, r.step): (r.exit_state, r.exit_class, r.exit_action) for r in st.exit_states(df, **more).collect()}

    taken, first = ("EARLY_PROFIT_TAKING_CANDIDATE", "PROFIT_EXIT", "NEXT_SESSION_REFERENCE_EXIT"), ("FIRST_RESISTANCE_REJECTION_WARNING", "WARNING_ONLY", "NONE")
    hold, risk, gone = ("HOLD_OR_REOBSERVE", "NONE", "NONE"), ("REPEATED_RESISTANCE_REJECTION_RISK", "WARNING_ONLY", "NONE"), ("KEY_SUPPORT_BREAK", "ENTRY_RISK", "NEXT_SESSION_REFERENCE_EXIT")
    assert states() == {("a", 2): first, ("a", 3): taken, ("b", 2): first, ("b", 3): taken, ("c", 2): hold, ("c", 3): gone, ("d", 2): first}
    assert states(stall="stalls") == {("a", 2): first, ("a", 3): taken, ("b", 2): first, ("b", 3): risk, ("c", 2): hold, ("c", 3): gone, ("d", 2): first}
    bars = [(2.0, 0.005, 0.6, True), (1.99, 0.0, 0.1, False), (3.0, -0.006, 0.1, False), (3.0, 0.0, 0.61, False), (None, 0.0, 0.1, False)]
    told = spark.createDataFrame(bars, "m double, b double, c double, want boolean")
    assert all(r.s == r.want for r in told.withColumn("s", st.stalled(F.col("m"), F.col("b"), F.col("c"))).collect())


def interpolated(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


@pytest.mark.parametrize("n", [7, 53, 130])
def test_block_bootstrap_values(spark, n):
    """The same draws taken one by one: blocks end to end, cut at the length of the series."""
    r = random.Random(n)
    x = [r.gauss(0.2, 1.0) for _ in range(n)]
    rows = [("k", i, v) for i, v in enumerate(x)] + [("k", 9999, None), ("empty", 1, None)]
    r.shuffle(rows)
    got = {o.k: o for o in stt.moving_block_interval(spark.createDataFrame(rows, "k string, o long, v double"), ["k"], "o", "v", repetitions=500, seed=5).collect()}
    rng, size, means = np.random.Generator(np.random.PCG64(5)), min(20, n), []
    for _ in range(2):
        starts = rng.integers(0, n - size + 1, (250, -(-n // size))).tolist()
        means += [statistics.fmean([x[s + j] for s in own for j in range(size)][:n]) for own in starts]
    assert got["k"].n == n and math.isclose(got["k"].low, interpolated(means, 0.025), abs_tol=1e-12) and math.isclose(got["k"].high, interpolated(means, 0.975), abs_tol=1e-12)
    assert got["empty"].n == 0 and got["empty"].low is None


def test_date_bootstrap_values(spark):
    """The same draws taken one by one, and the normal approximation of the interval."""
    r = random.Random(4)
    rows = [(r.gauss(0, 1), r.gauss(3, 2)) for _ in range(90)]
    df = spark.createDataFrame(rows + [(None, 1.0)], "a double, b double")
    got = {o.measure: (o.low, o.high) for o in stt.date_bootstrap(df.repartition(5), ["a", "b"], draws=1000, seed=6).collect()}
    ordered, means = sorted(rows), {"a": [], "b": []}
    for chunk in range(4):
        picks = np.random.Generator(np.random.PCG64([6, chunk])).integers(0, len(rows), (250, len(rows))).tolist()
        for i, c in enumerate("ab"):
            means[c] += [statistics.fmean(ordered[p][i] for p in own) for own in picks]
    for i, c in enumerate("ab"):
        assert math.isclose(got[c][0], interpolated(means[c], 0.025), abs_tol=1e-9) and math.isclose(got[c][1], interpolated(means[c], 0.975), abs_tol=1e-9)
        own = [z[i] for z in rows]
        half = 1.96 * statistics.pstdev(own) / math.sqrt(len(own))
        assert abs(got[c][0] - (statistics.fmean(own) - half)) < 0.3 * half and abs(got[c][1] - (statistics.fmean(own) + half)) < 0.3 * half
    none = {o.measure: (o.low, o.high) for o in stt.date_bootstrap(df.where("a > 100"), ["a", "b"], draws=500).collect()}
    assert none == {"a": (None, None), "b": (None, None)}


def test_backfill_keeps_every_locked_row(spark):
    locked = spark.createDataFrame([("s1", "a", 1, 2.0), ("s2", "a", 2, 9.0), ("s3", "a", 3, 2.0), ("s4", "b", 1, 2.0), ("s5", "c", 1, 2.0), ("s6", "c", 2, None)], "signal_id string, symbol string, date int, locked_close double")
    panel = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0), ("b", 1, 2.0), ("c", 1, 2.0), ("c", 2, 2.0)], "symbol string, date int, close double")
    seen = spark.createDataFrame([("a", 1, 0.5, None, 1.5, None), ("a", 2, 0.5, None, 1.5, None), ("a", 3, 0.5, None, 1.5, None), ("b", 1, 0.25, None, None, "WHY"), ("c", 2, 0.1, None, 1.0, None)], "symbol string, date int, u double, u_reason string, v double, v_reason string")
    out = {r.signal_id: tuple(r)[1:] for r in lg.backfill(locked, panel, seen, {"u": "u_reason", "v": "v_reason"}).collect()}
    none = (None, None, None, None)
    assert out == {"s1": ("COMPLETE", 0.5, None, 1.5, None), "s2": ("IDENTITY_MISMATCH", *none), "s3": ("BAR_MISSING", *none), "s4": ("PARTIAL", 0.25, None, None, "WHY"), "s5": ("NO_OBSERVATION", *none), "s6": ("IDENTITY_MISMATCH", *none)}
