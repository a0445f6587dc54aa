"""Pattern predicates, ordered reject gates, price levels and scores, as columns over the features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import features as fx

# Fixed values of the rules.
MIN_BARS = 120
RANGE_MAX, VOLUME_MIN, CHANGE_MIN = 0.30, 1.8, 3.0
STOP_SHARE, TARGET_ROOM, OVERHANG_ROOM = 0.98, 1.03, 1.02
NOT_MATCHED, INSUFFICIENT, REJECTED, QUALIFIED = "NOT_MATCHED", "INSUFFICIENT_DATA", "MATCHED_REJECTED", "QUALIFIED_LEGACY_BASELINE"


def names_where(conditions: dict[str, Column], value: bool) -> Column:
    """The names of the conditions that are (not) met, in order."""
    listed = F.array(*[F.when(F.coalesce(c, F.lit(False)) == value, F.lit(n)) for n, c in conditions.items()])
    return F.filter(listed, lambda x: x.isNotNull())


def platform_conditions() -> dict[str, Column]:
    c = F.col
    return {
        "PLATFORM_RANGE": c("plat_range") <= RANGE_MAX,
        "CLOSE_ABOVE_PRIOR_HIGH": c("close") > c("prev60_hi_c"),
        "VOLUME_EXPANSION": c("vol_ratio_k") >= VOLUME_MIN,
        "DAY_CHANGE": c("chg1") >= CHANGE_MIN,
        "ABOVE_MA20": c("close") > c("ma20"),
    }


def platform_match(features: DataFrame) -> DataFrame:
    """Adds matched, matched_conditions and failed_conditions; fewer than 120 bars match nothing."""
    conditions = platform_conditions()
    met = F.lit(True)
    for x in conditions.values():
        met = met & F.coalesce(x, F.lit(False))
    return features.select("*", (met & (F.col("rn") >= MIN_BARS)).alias("matched"), names_where(conditions, True).alias("matched_conditions"), names_where(conditions, False).alias("failed_conditions"))


def retest_match(panel: DataFrame) -> DataFrame:
    """The first breakout of the last bars, and four tests of the pullback since; a failed first breakout is final."""
    x = fx.first_breakout(panel)
    x = x.withColumn("ma5", F.avg("close").over(fx.back(-4))).withColumn("prev_close", F.lag("close").over(fx.by_symbol()))
    # Mean volume since the breakout: its age is at most 14, so a list of 14 volumes holds it.
    x = x.withColumn("recent", F.reverse(F.collect_list("volume").over(fx.back(-13)))).withColumn("age", (F.col("rn") - F.col("bo.rn")).cast("int"))
    since = F.slice("recent", 1, F.col("age"))
    x = x.withColumn("pull_v", F.when(F.col("bo").isNotNull(), F.aggregate(since, F.lit(0.0), lambda a, v: a + v) / F.col("age")))
    base, c = F.col("bo.base_hi"), F.col("close")
    tests = {
        "PULLBACK_CLOSE_GE_97_PCT_BASE": c >= base * 0.97,
        "PULLBACK_WITHIN_PLATFORM_4_PCT": (F.abs(c / base - 1) <= 0.04) | ((c >= base * 0.97) & (c <= base * 1.04)),
        "PULLBACK_VOLUME_LT_70_PCT_BREAKOUT": F.col("pull_v") < F.col("bo.volume") * 0.7,
        "PULLBACK_TURNED_STRONG": (c >= F.col("prev_close")) | (c >= F.col("ma5")),
    }
    met = F.col("bo").isNotNull() & (F.col("rn") >= MIN_BARS)
    for t in tests.values():
        met = met & t
    return x.select("*", F.coalesce(met, F.lit(False)).alias("matched"), names_where(tests, False).alias("failed_tests"))


def levels(features: DataFrame, breakout_price: str = "prev60_hi_c") -> DataFrame:
    """Support (highest valid of four), stop, risk, target (nearest pressure or 2.5 R), reward ratio and trigger.

    ``vol_edge`` is the lower edge of the fullest volume bin above the close, where a profile is there.
    """
    c = F.col("close")
    supports = F.array("ma20", breakout_price, "vol_bar_lo", "min_low20")
    edge = [F.col("vol_edge")] if "vol_edge" in features.columns else []
    pressures = F.array(F.col("max_high60"), *edge, F.col("max_high120"))
    x = features.withColumn("support", F.array_max(F.filter(supports, lambda s: s < F.col("close"))))
    x = x.withColumn("stop", F.round(F.col("support") * STOP_SHARE, 2)).withColumn("risk", (c - F.col("stop")) / c)
    x = x.withColumn("pressure", F.array_min(F.filter(pressures, lambda p: p > F.col("close") * TARGET_ROOM)))
    x = x.withColumn("target_type", F.when(F.col("pressure").isNotNull(), "PRESSURE").otherwise("TREND_2_5R"))
    x = x.withColumn("target", F.coalesce("pressure", c * (1 + 2.5 * F.col("risk"))))
    x = x.withColumn("rr", F.try_divide(F.col("target") - c, c - F.col("stop")))
    return x.withColumn("trigger", F.round(F.greatest(breakout_price, "ma5"), 2))


def first_reject() -> Column:
    """The first gate that fails, in order; null where all pass."""
    c = F.col
    return (
        F.when(c("close") <= 2, "PRICE_TOO_LOW")
        .when((c("chg10") > 35) & (c("bias20") > 15), "OVERHEATED_10D")
        .when((c("pos250") > 0.9) & (c("chg20") > 40), "EXTENDED_20D")
        .when(c("support").isNull(), "NO_VALID_SUPPORT")
        .when((c("risk") <= 0) | (c("risk") > 0.09), "RISK_OUT_OF_RANGE")
        .when(c("rr").isNull() | (c("rr") < 2), "REWARD_TOO_SMALL")
        .when((c("overhang") > 0.5) & (c("rr") < 2.5), "OVERHANG")
    )


def steps(value: Column, cuts: list[tuple[Column, int]], rest: int) -> Column:
    out = F.when(cuts[0][0], cuts[0][1])
    for condition, points in cuts[1:]:
        out = out.when(condition, points)
    return out.otherwise(rest)


def score(bonus: int = 3) -> Column:
    """At most 85 points from eight step functions; setup quality with its bonus counts at most 15."""
    c = F.col
    sector = steps(c("sector_rank"), [(c("sector_rank") <= 10, 10), (c("sector_rank") <= 20, 6)], 2)
    place = steps(c("pos250"), [((c("pos250") < 0.35) & (c("chg10") <= 30), 15), (c("pos250") < 0.5, 10), (c("pos250") < 0.65, 5)], 0)
    setup = steps(c("ud_ratio"), [(c("ud_ratio") >= 1.3, 8), (c("ud_ratio") >= 1.1, 5)], 2) + steps(c("vol_ratio_k"), [(c("vol_ratio_k").between(1.5, 4), 4), (c("vol_ratio_k") > 4, 2)], 1) + bonus
    risk = steps(c("risk"), [(c("risk") <= 0.04, 10), (c("risk") <= 0.06, 6)], 3)
    trend = steps(c("close"), [((c("close") > c("ma5")) & (c("ma5") >= c("ma5_prev")), 5), (c("close") > c("ma5"), 3)], 0)
    warmth = steps(c("sector_chg"), [(c("sector_chg") >= 1, 10), (c("sector_chg") > 0, 5)], 1)
    strength = steps(c("rs"), [(c("rs") > 3, 10), (c("rs") > 0, 6)], 2)
    reward = steps(c("rr"), [(c("rr") >= 3, 10), (c("rr") >= 2.5, 8)], 5)
    return (sector + place + F.least(setup, F.lit(15)) + risk + trend + warmth + strength + reward).cast("int")


def pivots(panel: DataFrame, radius: int = 2) -> DataFrame:
    """Pivot lows and highs: not above (below) any of ``radius`` bars on either side; known ``radius`` bars later."""
    left, right = fx.back(-radius, -1), fx.back(1, radius)
    n = F.count("low").over(left) + F.count("low").over(right)
    whole = n == 2 * radius
    return panel.select(
        "*",
        (whole & (F.col("low") <= F.min("low").over(left)) & (F.col("low") <= F.min("low").over(right))).alias("is_low"),
        (whole & (F.col("high") >= F.max("high").over(left)) & (F.col("high") >= F.max("high").over(right))).alias("is_high"),
    )


def board(symbol: Column) -> Column:
    prefix = F.substring(symbol, 1, 2)
    return F.when(prefix == "68", "STAR").when(prefix == "30", "ChiNext").when(prefix.isin("00", "60"), "Main").otherwise("Unknown")


def cooldown(events: DataFrame, key: str, place: str, gap: int = 10) -> DataFrame:
    """Greedy thinning per key: an event stays if it is more than ``gap`` places after the last one that stayed.

    An ordered fold over the key's places; the array is as long as the key's own history.
    """
    listed = events.groupBy(key).agg(F.array_sort(F.collect_list(place)).alias("places"))

    def step(kept, x):
        return F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) > gap), F.array_append(kept, x)).otherwise(kept)

    first = F.slice("places", 1, 1)
    kept = F.aggregate(F.slice("places", 2, F.size("places")), first, step)
    return listed.select(key, F.explode(kept).alias(place))
