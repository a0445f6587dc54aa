"""Pullback diagnosis against a plain version on random walks, where all kinds of near misses occur."""

import datetime
import math
import random

import pytest

from barlattice.operators import structure as st

SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double, turnover double"


def walks(n_symbols=60, n_bars=290):
    r = random.Random(31)
    rows = []
    for s in range(n_symbols):
        price = 10.0
        for i in range(n_bars if s else 40):
            day = datetime.date(2020, 1, 1) + datetime.timedelta(days=i)
            o = price * (1 + r.uniform(-0.004, 0.006))
            c = o * (1 + r.gauss(0.0025, 0.012))
            rows.append((f"{s:06d}", day, o, max(o, c) * (1 + r.uniform(0, 0.008)), min(o, c) * (1 - r.uniform(0, 0.008)), c, 100.0, 1.0))
            price = c
    return rows


def plain(bars, rule):
    """(status, pairs, least failed, {class: (condition, margin)}) of one symbol's bars (open, high, low, close)."""
    all_closes = [b[3] for b in bars]
    bars = bars[-260:]
    t = len(bars) - 1
    now, before = bars[t], bars[t - 1]
    trend = [None] * 4
    if len(all_closes) >= max(rule.trend, rule.slow):
        fast, slow = (sum(all_closes[-n:]) / n for n in (rule.fast, rule.slow))
        y = [math.log(c) for c in all_closes[-rule.trend :]]
        mx, my = (rule.trend - 1) / 2, sum(y) / rule.trend
        slope = sum((i - mx) * (v - my) for i, v in enumerate(y)) / sum((i - mx) ** 2 for i in range(rule.trend))
        last = all_closes[-rule.trend :]
        up = sum(b > a for a, b in zip(last, last[1:])) / (rule.trend - 1)
        trend = [now[3] > fast, fast > slow, slope > 0, up >= rule.up_fraction]
        margins = [now[3] - fast, fast - slow, slope, up - rule.up_fraction]
    k = rule.radius
    spots = [i for i in range(k, len(bars) - k) if i < t - k]
    lows = [i for i in spots if all(bars[i][2] <= bars[j][2] for j in range(i - k, i + k + 1))]
    highs = [i for i in spots if all(bars[i][1] >= bars[j][1] for j in range(i - k, i + k + 1))]
    place = (now[3] - now[2]) / (now[1] - now[2]) if now[1] > now[2] else 1.0

    def between(v, ends):
        return None if v is None else ends[0] <= v <= ends[1]

    def short(v, ends):
        return v - ends[0] if v < ends[0] else ends[1] - v

    contexts = []
    for two in reversed(lows):
        for one in reversed([i for i in lows if two - i >= rule.apart and bars[two][2] > bars[i][2]]):
            peak, rebound = max((i for i in highs if i < one), default=None), max((i for i in highs if i > two), default=None)
            depth = None if peak is None else (bars[peak][1] - min(b[2] for b in bars[peak + 1 : t])) / bars[peak][1]
            size = None if rebound is None else (bars[rebound][1] - bars[two][2]) / bars[two][2]
            gates = [peak is not None, None if peak is None else t - peak <= rule.reach, between(depth, rule.depth), rebound is not None, between(size, rule.rebound)]
            confirm = [None] * 4 if rebound is None else [now[3] > bars[rebound][1], now[3] > before[3], now[3] > now[0], place >= rule.close_location]
            least = None if peak is None else min(b[3] for b in bars[peak + 1 :])
            support = None if peak is None else least >= bars[one][2]
            values = dict(zip((*st.TREND, *st.GATES, *st.CONFIRMATION, *st.SUPPORT), (*trend, *gates, *confirm, support)))
            failed = [n for n, v in values.items() if v is False] if None not in values.values() else None
            margin = None
            if failed and len(failed) == 1:
                margin = dict(zip((*st.TREND, "peak_age_ok", "depth_ok", "rebound_size_ok", *st.CONFIRMATION, "entry_support_ok"), (*margins, rule.reach - (t - peak), short(depth, rule.depth), short(size, rule.rebound), now[3] - bars[rebound][1], now[3] - before[3], now[3] - now[0], place - rule.close_location, least - bars[one][2])))[failed[0]]
            contexts.append((all(gates), failed, margin))
            if all(gates):
                break
        else:
            continue
        break
    near = contexts[-1:] if contexts and contexts[-1][0] else contexts
    counts = [len(f) for _, f, _ in near if f is not None]
    found = {}
    for _, f, m in near:
        if m is not None:
            name = st.NEAR_MISS[f[0]]
            if name not in found or round(abs(m), 9) < round(abs(found[name][1]), 9):
                found[name] = (f[0], m)
    return len(contexts), min(counts, default=None), found


@pytest.mark.parametrize("rule", [st.BALANCED, st.CONSERVATIVE])
def test_diagnosis(spark, rule):
    rows = walks()
    x = st.pair_contexts(spark.createDataFrame(rows, SCHEMA).repartition(3), rule)
    whole = {r.symbol: r for r in st.diagnosis(x, rule).collect()}
    near = {}
    for r in st.near_misses(x, rule).collect():
        near.setdefault(r.symbol, {})[r.near_miss_class] = (r.condition, r.margin)
    by_symbol = {}
    for s, _, o, h, l, c, *_ in rows:
        by_symbol.setdefault(s, []).append((o, h, l, c))
    kinds = set()
    for s, bars in by_symbol.items():
        pairs, least, found = plain(bars, rule)
        assert (whole[s].pairs, whole[s].least_failed) == (pairs, least), s
        got = near.get(s, {})
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in found.items()}, s
        assert all(abs(got[k][1] - found[k][1]) < 1e-9 for k in found)
        kinds |= set(found)
        assert whole[s].matched == (whole[s].structure_status == "OK" and least == 0)
    assert whole["000000"].structure_status == ("INSUFFICIENT_HISTORY")
    assert len(kinds) >= 2 and len({r.structure_status for r in whole.values()}) >= 2
