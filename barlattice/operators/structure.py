"""Pullback structures: two rising pivot lows below an earlier peak, a rebound between, and what follows.

Everything a bar needs lies within ``reach`` bars before it, so each bar looks at one short array.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import features as fx
from . import patterns as pt


#: Bars before the pullback that its volume is compared with.
BASELINE = 20
#: Rising and falling bars that a median by direction needs.
DIRECTIONAL = 2


@dataclass(frozen=True)
class Rule:
    """Fixed values of a rule."""

    trend: int = 60
    fast: int = 20
    slow: int = 60
    up_fraction: float = 0.55
    radius: int = 2
    apart: int = 3
    pullback: int = 20
    depth: tuple[float, float] = (0.03, 0.12)
    rebound: tuple[float, float] = (0.02, 0.08)
    tolerance: float = 0.01
    close_location: float = 0.60

    @property
    def reach(self) -> int:
        return self.pullback + 2 * self.radius


BALANCED = Rule()
CONSERVATIVE = Rule(90, 20, 90, 0.60, 3, 4, 25, (0.04, 0.15), (0.02, 0.10), 0.015, 0.60)


def pullback_structures(numbered: DataFrame, rule: Rule = BALANCED, more: tuple[str, ...] = ()) -> DataFrame:
    """Bars with a structure: peak, first and second low, rebound high, depth, all before the bar. ``more`` columns are passed on.

    Pivots must be confirmed by bars that end before it. Pairs of lows are tried from the latest second
    low and, for it, the latest first low; the first pair that fits in all respects is taken.
    """
    x = pt.pivots(numbered, rule.radius)
    past = F.collect_list(F.struct("rn", "low", "high", "close")).over(fx.back(-rule.reach, -1))
    # The peak of a low is the last high before it; the rebound of any second low is the last high known at the bar.
    high = F.when(F.col("is_high"), F.struct("rn", "high"))
    x = x.select("*", F.last(high, ignorenulls=True).over(fx.by_symbol().rowsBetween(Window.unboundedPreceding, -1)).alias("peak"), F.last(high, ignorenulls=True).over(fx.by_symbol().rowsBetween(Window.unboundedPreceding, -1 - rule.radius)).alias("rebound"))
    lows = F.collect_list(F.when(F.col("is_low"), F.struct("rn", "low", "peak"))).over(fx.back(-rule.reach, -1 - rule.radius))
    bottoms = F.collect_list(F.coalesce("low", F.lit(float("nan")))).over(fx.back(-rule.reach, -1))
    x = x.select("symbol", "date", "rn", "open", "high", "low", "close", F.lag("close").over(fx.by_symbol()).alias("prev_close"), F.avg("close").over(fx.back(-4)).alias("ma5"), past.alias("past"), F.reverse(lows).alias("lows"), bottoms.alias("bottoms"), "rebound", *[F.collect_list(c).over(fx.back(-rule.reach - BASELINE, -1)).alias(f"{c}s") for c in ("volume", "close")], *more)
    x = x.where(F.col("rn") >= max(rule.slow, rule.reach + 2))

    def first(a):
        """A first low: the depth depends on it alone, by the peak before it and the lows from there to the bar."""
        n = (F.col("rn") - 1 - a["peak"]["rn"]).cast("int")
        floor = F.array_min(F.slice("bottoms", F.size("bottoms") - n + 1, n))
        return F.struct(a["rn"].alias("rn1"), a["low"].alias("low1"), a["peak"]["rn"].alias("peak_rn"), a["peak"]["high"].alias("peak"), ((a["peak"]["high"] - floor) / a["peak"]["high"]).alias("depth"))

    def second(b):
        return F.struct(b["rn"].alias("rn2"), b["low"].alias("low2"), F.col("rebound.rn").alias("rebound_rn"), F.col("rebound.high").alias("rebound"), ((F.col("rebound.high") - b["low"]) / b["low"]).alias("size"))

    firsts = F.filter(F.transform(F.filter("lows", lambda a: a["peak"]["rn"] >= F.col("rn") - rule.reach), first), lambda a: a["depth"].between(*rule.depth))
    seconds = F.filter(F.transform(F.filter("lows", lambda b: F.col("rebound.rn") > b["rn"]), second), lambda b: b["size"].between(*rule.rebound))
    # A one-element array binds both, so that each low is judged once and not for each pair.
    x = x.select("*", F.explode(F.array(F.struct(firsts.alias("firsts"), seconds.alias("seconds")))).alias("of"))

    def pairs(b):
        near = F.filter("of.firsts", lambda a: (b["rn2"] - a["rn1"] >= rule.apart) & (b["low2"] > a["low1"]))
        return F.transform(near, lambda a: F.struct(a["rn1"], a["low1"], b["rn2"], b["low2"], a["peak_rn"], a["peak"], b["rebound_rn"], b["rebound"], a["depth"], b["size"]))

    fits = F.flatten(F.transform("of.seconds", pairs))
    # Exploding the first fit computes it once for all later uses; no filter moves below it.
    out = ["symbol", "date", "rn", "open", "high", "low", "close", "prev_close", "ma5", "past", "volumes", "closes", *more]
    return x.select(*out, F.explode(F.slice(fits, 1, 1)).alias("s")).select(*out, "s.*")


def volume_path(structures: DataFrame) -> DataFrame:
    """Medians of the pullback's volume (peak to the bar before), of its halves, of the bars before it, and by direction."""
    n = (F.col("rn") - 1 - F.col("peak_rn")).cast("int")
    x = structures.withColumn("n", n)
    pull = F.slice("volumes", F.size("volumes") - F.col("n") + 1, F.col("n"))
    start = F.greatest(F.size("volumes") - F.col("n") - BASELINE, F.lit(0)) + 1
    reference = F.slice("volumes", start, F.size("volumes") - F.col("n") - start + 1)
    closes = F.slice("closes", F.size("closes") - F.col("n") + 1, F.col("n"))
    before = F.slice("closes", F.size("closes") - F.col("n"), F.col("n"))
    # Arrays are exploded once, so that what they are made of is not worked out again for each use.
    x = x.select("symbol", "date", "n", F.explode(F.array(F.struct(pull.alias("pull"), reference.alias("ref"), F.arrays_zip(pull.alias("v"), closes.alias("c"), before.alias("b")).alias("bars")))).alias("a")).select("symbol", "date", "n", "a.*")
    half = F.floor((F.col("n") + 1) / 2).cast("int")

    def directed(rising):
        kept = F.filter("bars", lambda z: z["c"] > z["b"] if rising else z["c"] < z["b"])
        return F.transform(kept, lambda z: z["v"])

    up, down = directed(True), directed(False)
    enough = (F.size(up) >= DIRECTIONAL) & (F.size(down) >= DIRECTIONAL)
    out = x.select(
        "symbol", "date", fx.median_of(F.col("pull")).alias("pull_median"), fx.median_of(F.col("ref")).alias("reference_median"), fx.median_of(F.slice("pull", 1, half)).alias("first_half"), fx.median_of(F.slice("pull", half + 1, F.col("n"))).alias("second_half"),
        F.when(enough, fx.median_of(up)).alias("up_median"), F.when(enough, fx.median_of(down)).alias("down_median"),
    )
    out = out.withColumn("ratio", F.when(F.col("reference_median") > 0, F.col("pull_median") / F.col("reference_median"))).withColumn("up_down_ratio", F.try_divide("up_median", "down_median"))
    label = F.when(F.col("ratio").isNull(), "UNDETERMINED").when(F.col("ratio") <= 0.80, "CONTRACTED_OBSERVABLE").when(F.col("ratio") >= 1.20, "EXPANDED_OBSERVABLE").otherwise("MIXED_OBSERVABLE")
    return out.withColumn("label", label)


def observations(structures: DataFrame, rule: Rule = BALANCED) -> DataFrame:
    """Confirmation on the bar itself, and what became of the support (the first low) in the pullback."""
    c, span = F.col("close"), F.col("high") - F.col("low")
    place = F.when(span > 0, (c - F.col("low")) / span).otherwise(1.0)
    inside = F.filter("past", lambda p: p["rn"] > F.col("peak_rn"))
    destroyed = F.exists(inside, lambda p: p["close"] < F.col("low1"))
    punctured = F.exists(inside, lambda p: (p["low"] < F.col("low1")) & (p["close"] >= F.col("low1")))
    support = (
        F.when(c < F.col("low1"), "T_CLOSE_BREAK").when(destroyed, "PULLBACK_SUPPORT_DESTROYED").when(F.col("low") < F.col("low1"), "T_INTRADAY_PUNCTURE_RECOVERED")
        .when(punctured, "PULLBACK_INTRADAY_PUNCTURE_RECOVERED").otherwise("INTACT")
    )
    confirmed = (c > F.col("rebound")) & (c > F.col("prev_close")) & (c > F.col("open")) & (place >= rule.close_location)
    return structures.withColumn("close_location", place).withColumn("support_state", support).withColumn("confirmed", confirmed)


def failed_pushes(structures: DataFrame, rule: Rule = BALANCED, window: int = 5) -> DataFrame:
    """Adds n_failed_pushes, among the last ``window`` bars after the peak, and run_at_end, those at the end without a break."""
    bars = F.concat(F.transform(F.slice("past", F.greatest(F.size("past") - window + 2, F.lit(1)), window - 1), lambda p: F.struct(p["rn"].alias("rn"), p["high"].alias("high"), p["low"].alias("low"), p["close"].alias("close"))), F.array(F.struct("rn", "high", "low", "close")))

    def fails(p):
        span = p["high"] - p["low"]
        place = F.when(span > 0, (p["close"] - p["low"]) / span).otherwise(1.0)
        return (p["high"] >= F.col("peak") * (1 - rule.tolerance)) & (p["close"] < F.col("peak")) & (place <= 0.60)

    flags = F.transform(F.filter(bars, lambda p: p["rn"] > F.col("peak_rn")), fails)
    x = structures.withColumn("flags", flags)
    run = F.aggregate("flags", F.lit(0), lambda n, f: F.when(f, n + 1).otherwise(0))
    return x.withColumn("n_failed_pushes", F.size(F.filter("flags", lambda f: f)).cast("long")).withColumn("run_at_end", run.cast("long")).drop("flags")


def limit_up(limit, tick, high, close) -> list:
    """status, touched and failed of a daily bar against its upper limit; unknown without a limit or a tick."""
    known = limit.isNotNull() & tick.isNotNull() & high.isNotNull() & close.isNotNull()
    touched = high >= limit - tick / 2
    return [F.when(known, "AVAILABLE_DAILY_PROXY").otherwise("UNAVAILABLE").alias("limit_up_status"), F.when(known, touched).alias("limit_up_touched"), F.when(known, touched & (close < limit - tick / 2)).alias("limit_up_failed")]


def stalled(median_ratio: Column, body_return: Column, close_location: Column, ratio: float = 2.0) -> Column:
    """Much volume and little progress: ``ratio`` medians of volume, a body of half a percent at most, a close in the lower 60 %."""
    return F.coalesce((median_ratio >= ratio) & (F.abs(body_return) <= 0.005) & (close_location <= 0.60), F.lit(False))


def fails_push(bar, peak: Column, rule: Rule = BALANCED) -> Column:
    """A push fails at the peak where the high reaches it within the tolerance, the close stays below and in the lower 60 %."""
    return (bar("high") >= peak * (1 - rule.tolerance)) & (bar("close") < peak) & (fx.close_location(bar) <= 0.60)


def with_next_bars(numbered: DataFrame, columns: list[str], steps: int = 10) -> DataFrame:
    """Adds ``after``, up to ``steps`` bars that follow each bar: a window over its symbol, so that structures need no join with bars."""
    return numbered.withColumn("after", F.collect_list(F.struct(*columns)).over(fx.back(1, steps)))


def pushes_after(structures: DataFrame, rule: Rule = BALANCED, window: int = 5) -> DataFrame:
    """symbol, date, floor, entry, step from 2, the columns of ``after``, push, and n, the failed pushes of the last ``window`` steps.

    ``structures`` pass ``after`` on. Pushes are counted within its short array: nothing is exchanged or sorted.
    """
    push = F.transform("after", lambda b, i: (fails_push(lambda c: b[c], F.col("peak"), rule) & (i > 0)).cast("int"))
    # A one-element array binds the pushes, so that they are judged once and not for each step.
    x = structures.select("symbol", "date", F.col("low1").alias("floor"), F.get("after", F.lit(0))["open"].alias("entry"), "after", F.explode(F.array(push)).alias("pushes"))
    x = x.select("symbol", "date", "floor", "entry", "pushes", F.posexplode("after").alias("at", "bar")).where("at > 0")
    last = F.slice("pushes", F.greatest(F.col("at") + 2 - window, F.lit(1)), F.least(F.col("at") + 1, F.lit(window)))
    known = F.filter(last, lambda p: p.isNotNull())
    n = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast("long"), lambda s, p: s + p))
    return x.select("symbol", "date", (F.col("at") + 1).cast("long").alias("step"), "floor", "entry", "bar.*", F.get("pushes", F.col("at")).alias("push"), n.alias("n"))


def exit_states(after: DataFrame, rule: Rule = BALANCED, window: int = 5, pushes: int = 2, stall: str | None = None) -> DataFrame:
    """State of each bar after the entry bar: support break, early profit, first warning, repeated risk or hold.

    With ``stall``, a column that tells a stalled bar, profit is taken early only on such a bar (the defence by price and
    volume); without, by price alone. ``exit_class`` and ``exit_action`` follow from the state; warnings are no action.

    ``after`` has (key, step from 1 = entry, entry, peak, floor, open, high, low, close).
    """
    push = fails_push(F.col, F.col("peak"), rule) & (F.col("step") > 1)
    x = after.withColumn("push", push.cast("int"))
    w = Window.partitionBy("key").orderBy("step").rowsBetween(1 - window, 0)
    x = x.withColumn("n", F.sum("push").over(w)).where("step > 1")
    return with_exits(x, pushes, stall).withColumnRenamed("n", "failed_pushes")


def with_exits(counted: DataFrame, pushes: int = 2, stall: str | None = None, suffix: str = "") -> DataFrame:
    """Adds exit_state, exit_class and exit_action, their names with the suffix, to steps with push and n, the pushes counted so far."""
    now, before = F.col("push") == 1, F.col("n") - F.col("push")
    early = now & (before >= 1) & (F.col("n") >= pushes) & (F.col("close") > F.col("entry"))
    if stall:
        early = early & F.col(stall)
    state = (
        F.when(F.col("close") < F.col("floor"), "KEY_SUPPORT_BREAK").when(early, "EARLY_PROFIT_TAKING_CANDIDATE").when(now & (before == 0), "FIRST_RESISTANCE_REJECTION_WARNING")
        .when(now, "REPEATED_RESISTANCE_REJECTION_RISK").otherwise("HOLD_OR_REOBSERVE")
    )
    name = f"exit_state{suffix}"
    broken, taken = F.col(name) == "KEY_SUPPORT_BREAK", F.col(name) == "EARLY_PROFIT_TAKING_CANDIDATE"
    kind = F.when(broken, F.when(F.col("close") > F.col("entry"), "PROFIT_PROTECTION").otherwise("ENTRY_RISK")).when(taken, "PROFIT_EXIT").when(F.col(name) == "HOLD_OR_REOBSERVE", "NONE").otherwise("WARNING_ONLY")
    x = counted.withColumn(name, state)
    return x.withColumn(f"exit_class{suffix}", kind).withColumn(f"exit_action{suffix}", F.when(broken | taken, "NEXT_SESSION_REFERENCE_EXIT").otherwise("NONE"))


#: What a pair of lows is judged by, in order: the trend, the structure, the bar itself, the support.
TREND = ("close_above_fast_average", "ma_order_ok", "positive_slope", "up_close_fraction_ok")
GATES = ("pre_pullback_peak_available", "peak_age_ok", "depth_ok", "rebound_high_available", "rebound_size_ok")
CONFIRMATION = ("close_above_rebound_high", "close_above_previous_close", "positive_body", "close_location_ok")
SUPPORT = ("entry_support_ok",)
NEAR_MISS = {**dict.fromkeys(TREND, "ONE_TREND_SUBCONDITION"), **dict.fromkeys(CONFIRMATION, "ONE_CONFIRMATION_SUBCONDITION"), "depth_ok": "DEPTH_ONLY", "peak_age_ok": "PEAK_AGE_ONLY", "rebound_size_ok": "REBOUND_SIZE_ONLY", "entry_support_ok": "SUPPORT_ONLY"}


def pair_contexts(panel: DataFrame, rule: Rule = BALANCED, history: int = 260) -> DataFrame:
    """Every pair of rising pivot lows of each symbol's last ``history`` bars, judged for its last bar T.

    One row per pair; a symbol without pairs has one row with a null ``rn1``. Conditions that cannot be
    told are null. All looks along a symbol are windows over its ``history`` bars, and pairs meet by
    symbol, at most some thousand for one.
    """
    from pyspark.sql import Window

    w, every = fx.by_symbol(), Window.partitionBy("symbol")
    x = panel.withColumn("rn", F.row_number().over(w)).withColumn("t", F.max("rn").over(every)).where(F.col("rn") > F.col("t") - history)
    # Only the last bar's trend is asked for, and it looks no further back than this.
    recent = x.where(F.col("rn") > F.col("t") - max(rule.slow, rule.trend) - 1)
    trend = fx.trend_features(recent.select("symbol", "date", "close"), rule.fast, rule.slow, rule.trend, rule.up_fraction).select("symbol", "date", "sma_fast", "sma_slow", "log_slope", "up_fraction")
    x = pt.pivots(x.withColumn("prev_close", F.lag("close").over(w)), rule.radius)
    after = Window.partitionBy("symbol").orderBy(F.col("rn").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before_t = F.col("rn") < F.col("t")
    x = x.withColumn("later_low", F.min(F.when(before_t, F.col("low"))).over(after)).withColumn("later_close", F.min(F.when(before_t, F.col("close"))).over(after))
    known = F.col("rn") < F.col("t") - rule.radius
    high = F.when(F.col("is_high") & known, F.struct("rn", "high", "later_low", "later_close"))
    x = x.withColumn("peak", F.last(high, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("last_high", F.max(high).over(every))
    last = x.where("rn = t").select("symbol", "date", "t", "open", "high", "low", "close", "prev_close").join(trend, ["symbol", "date"], "left")
    lows = x.where(F.col("is_low") & known)
    first = lows.select("symbol", F.col("rn").alias("rn1"), F.col("low").alias("low1"), "peak")
    second = lows.select(F.col("symbol").alias("__s"), F.col("rn").alias("rn2"), F.col("low").alias("low2"), F.when(F.col("last_high.rn") > F.col("rn"), F.col("last_high")).alias("rebound"))
    pairs = first.join(second, (F.col("symbol") == F.col("__s")) & (F.col("rn2") - F.col("rn1") >= rule.apart) & (F.col("low2") > F.col("low1"))).drop("__s")
    y = last.join(pairs, "symbol", "left")
    c, span = F.col("close"), F.col("high") - F.col("low")
    y = y.withColumn("age", F.col("t") - F.col("peak.rn")).withColumn("depth", (F.col("peak.high") - F.col("peak.later_low")) / F.col("peak.high")).withColumn("size", (F.col("rebound.high") - F.col("low2")) / F.col("low2"))
    y = y.withColumn("place", F.when(span > 0, (c - F.col("low")) / span).otherwise(1.0)).withColumn("least_close", F.least(c, F.col("peak.later_close")))
    paired = F.col("rn1").isNotNull()
    conditions = {
        "close_above_fast_average": c > F.col("sma_fast"), "ma_order_ok": F.col("sma_fast") > F.col("sma_slow"), "positive_slope": F.col("log_slope") > 0, "up_close_fraction_ok": F.col("up_fraction") >= rule.up_fraction,
        "pre_pullback_peak_available": F.when(paired, F.col("peak").isNotNull()), "peak_age_ok": F.col("age") <= rule.reach, "depth_ok": F.col("depth").between(*rule.depth),
        "rebound_high_available": F.when(paired, F.col("rebound").isNotNull()), "rebound_size_ok": F.col("size").between(*rule.rebound),
        "close_above_rebound_high": c > F.col("rebound.high"), **{n: F.when(F.col("rebound").isNotNull(), e) for n, e in {"close_above_previous_close": c > F.col("prev_close"), "positive_body": c > F.col("open"), "close_location_ok": F.col("place") >= rule.close_location}.items()},
        "entry_support_ok": F.when(F.col("peak").isNotNull(), F.col("least_close") >= F.col("low1")),
    }
    y = y.select("*", *[e.alias(n) for n, e in conditions.items()])
    names = [*TREND, *GATES, *CONFIRMATION, *SUPPORT]
    known_all, fails = F.lit(True), F.lit(0)
    for n in names:
        known_all, fails = known_all & F.col(n).isNotNull(), fails + F.coalesce((~F.col(n)).cast("int"), F.lit(0))
    fits = F.lit(True)
    for n in GATES:
        fits = fits & F.coalesce(F.col(n), F.lit(False))
    y = y.withColumn("failed_count", F.when(known_all, fails)).withColumn("fits", fits & paired)
    place = F.struct("rn2", "rn1")
    # Pairs are tried from the latest second low and, for it, the latest first low; the first that fits ends the search.
    y = y.withColumn("chosen", F.max(F.when(F.col("fits"), place)).over(every))
    y = y.where(F.col("chosen").isNull() | (place >= F.col("chosen")))
    return y.withColumn("near", paired & (F.col("chosen").isNull() | (place == F.col("chosen"))))


def diagnosis(contexts: DataFrame, rule: Rule = BALANCED) -> DataFrame:
    """One row per symbol: structure status, match, pairs tried, failures of each gate and the least number of failed conditions."""
    def met(names):
        out = F.lit(True)
        for n in names:
            out = out & F.coalesce(F.col(n), F.lit(False))
        return out

    one = met(TREND) & F.col("fits") & met(CONFIRMATION) & met(SUPPORT)
    x = contexts.groupBy("symbol", "date").agg(
        F.max("t").alias("bars"), F.count("rn1").alias("pairs"), F.max("fits").alias("fitted"), F.max(F.coalesce("pre_pullback_peak_available", F.lit(False))).alias("peaks"),
        F.max(F.coalesce(F.col("peak_age_ok") & F.col("depth_ok"), F.lit(False))).alias("aged"), F.max(one).alias("matched"), F.min(F.when(F.col("near"), F.col("failed_count"))).cast("long").alias("least_failed"),
        *[F.count_if(~F.col(n)).alias(f"n_{n}_failed") for n in GATES],
    )
    status = (
        F.when(F.col("bars") < max(rule.slow, rule.reach + 2), "INSUFFICIENT_HISTORY").when(F.col("fitted"), "OK").when(F.col("pairs") == 0, "NO_DISTINCT_HIGHER_LOW_PAIR")
        .when(~F.col("peaks"), "NO_PRE_PULLBACK_PEAK").when(~F.col("aged"), "PULLBACK_DEPTH_OUTSIDE_CANDIDATE").otherwise("NO_CONFIRMED_REBOUND_HIGH")
    )
    return x.select("symbol", "date", status.alias("structure_status"), "matched", "pairs", "least_failed", *[f"n_{n}_failed" for n in GATES])


def near_misses(contexts: DataFrame, rule: Rule = BALANCED) -> DataFrame:
    """Per symbol and class of near miss, the pair with exactly one failed condition that fails by least: value, threshold, signed margin.

    A range is missed at the end that the value is beyond; equal margins go to the pair tried first.
    """
    c = F.col
    bounds = {
        "close_above_fast_average": (c("close"), c("sma_fast")), "ma_order_ok": (c("sma_fast"), c("sma_slow")), "positive_slope": (c("log_slope"), F.lit(0.0)), "up_close_fraction_ok": (c("up_fraction"), F.lit(rule.up_fraction)),
        "close_above_rebound_high": (c("close"), c("rebound.high")), "close_above_previous_close": (c("close"), c("prev_close")), "positive_body": (c("close"), c("open")), "close_location_ok": (c("place"), F.lit(rule.close_location)),
        "entry_support_ok": (c("least_close"), c("low1")),
    }
    facts = {n: (v, t, v - t) for n, (v, t) in bounds.items()}
    for n, v, (low, high) in (("depth_ok", c("depth"), rule.depth), ("rebound_size_ok", c("size"), rule.rebound)):
        facts[n] = (v, F.when(v < low, F.lit(low)).otherwise(F.lit(high)), F.when(v < low, v - low).otherwise(high - v))
    facts["peak_age_ok"] = (c("age").cast("double"), F.lit(float(rule.reach)), (rule.reach - c("age")).cast("double"))
    sample = F.coalesce(*[F.when(~c(n), F.struct(F.lit(NEAR_MISS[n]).alias("near_miss_class"), F.lit(n).alias("condition"), v.cast("double").alias("value"), t.cast("double").alias("threshold"), m.cast("double").alias("margin"))) for n, (v, t, m) in facts.items()])
    x = contexts.where("near AND failed_count = 1").withColumn("s", sample).where("s IS NOT NULL")
    least = F.min_by("s", F.struct(F.round(F.abs("s.margin"), 9), -c("rn2"), -c("rn1"))).alias("s")
    x = x.groupBy("symbol", "date", F.col("s.near_miss_class").alias("near_miss_class")).agg(least)
    return x.select("symbol", "date", "near_miss_class", "s.condition", "s.value", "s.threshold", "s.margin")
