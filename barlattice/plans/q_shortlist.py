"""Dominance among candidates of a date (o5.11), fronts to the last one and the shortlist (o7.14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.operators import fronts as fr
from barlattice.sources import panel as P

from .q_features import observation_of, structure_of
from .registry import ORACLE_SQL, query
from .sql import rounded

STAGE = "RECOVERING"
NO_REASON = "why = ''"


def candidates(spark, d):
    """Bars in a pullback with their state, volume observation and reference prices; the target is the high since the breakout."""
    bars = P.kept_bars(spark, d)
    panel = bars.select("symbol", "date", F.round("close", 4).alias("price"), F.round(F.col("high") * 1.0005, 4).alias("trigger"), F.round(F.col("low") * 0.995, 4).alias("stop"))
    volume = observation_of(bars).select("symbol", "date", "down_volume_share", "up_down_volume_ratio", (F.col("share_reason").isNotNull() | F.col("ratio_reason").isNotNull()).alias("volume_missing"))
    structure = structure_of(bars).select("symbol", "date", "state", F.round(F.col("h1") * 1.01, 4).alias("target"))
    return volume.join(structure, ["symbol", "date"]).join(panel, ["symbol", "date"]).withColumnRenamed("symbol", "code")


CANDIDATES = f"""WITH RECURSIVE vo AS ({ORACLE_SQL['o3_12_pullback_observation']}), so AS ({ORACLE_SQL['o3_16_structure_proxy']}), {P.BARS},
ca AS (SELECT b.symbol AS code, date, state, down_volume_share, up_down_volume_ratio, (share_reason IS NOT NULL OR ratio_reason IS NOT NULL) AS volume_missing, round(b.close, 4) AS price, round(b.high * 1.0005, 4) AS trigger, round(b.low * 0.995, 4) AS stop, round(h1 * 1.01, 4) AS target
  FROM vo JOIN so USING (symbol, date) JOIN bars b USING (symbol, date)),
cb AS (SELECT *, greatest(price, trigger) AS entry, coalesce(stop > 0 AND stop < trigger AND greatest(price, trigger) < target, FALSE) AS prices, coalesce(down_volume_share BETWEEN 0 AND 1 AND up_down_volume_ratio >= 0 AND NOT volume_missing, FALSE) AS volumes FROM ca),
cc AS MATERIALIZED (SELECT *, CASE WHEN prices THEN (entry - stop) / entry END AS risk_fraction, CASE WHEN prices THEN (target - entry) / (entry - stop) END AS reward_risk, concat_ws('|', CASE WHEN NOT prices THEN 'INVALID_REFERENCE_PRICES' END, CASE WHEN NOT volumes THEN 'V1_V2_UNAVAILABLE_OR_INVALID' END, CASE WHEN state <> '{STAGE}' THEN 'OUTSIDE_COMPARISON_STAGE' END) AS why FROM cb)"""


def vectors(where: str) -> str:
    return f"ve AS MATERIALIZED (SELECT date, code, -round(down_volume_share, 12) AS a, round(up_down_volume_ratio, 12) AS b, -round(risk_fraction, 12) AS c, round(reward_risk, 12) AS e FROM cc WHERE {where})"


BETTER = "o.a >= x.a AND o.b >= x.b AND o.c >= x.c AND o.e >= x.e AND (o.a > x.a OR o.b > x.b OR o.c > x.c OR o.e > x.e)"
PAIRS = f"dp AS MATERIALIZED (SELECT x.date, x.code, o.code AS dominator FROM ve x JOIN ve o ON o.date = x.date AND {BETTER})"


@query("o5_11b_dominators", f"{CANDIDATES}, {vectors('prices AND volumes')}, {PAIRS} SELECT * FROM dp")
def dominators(spark, d):
    """Who dominates whom in four coordinates, among all candidates of a date with valid prices and ratios, whatever their state."""
    x = fr.judged(candidates(spark, d).withColumn("state", F.lit(STAGE)), STAGE).where(F.size("reasons") == 0)
    coordinates = {"a": -F.round("down_volume_share", 12), "b": F.round("up_down_volume_ratio", 12), "c": -F.round("risk_fraction", 12), "e": F.round("reward_risk", 12)}
    return fr.dominators(x.select("date", "code", *[v.alias(k) for k, v in coordinates.items()]), "date", "code", list(coordinates))


@query(
    "o7_14c_fronts_and_shortlist",
    f"{CANDIDATES}, {vectors(NO_REASON)}, {PAIRS}, ch AS (SELECT date, code, 1 AS k FROM ve UNION SELECT dp.date, dp.code, ch.k + 1 FROM ch JOIN dp ON dp.date = ch.date AND dp.dominator = ch.code), "
    "fr AS (SELECT date, code, max(k) AS front FROM ch GROUP BY 1, 2), nd AS (SELECT date, code, count(*) AS n FROM dp GROUP BY 1, 2), "
    "pl AS (SELECT ve.date, ve.code, front, coalesce(n, 0) AS n_dominators, row_number() OVER (PARTITION BY ve.date ORDER BY front, e DESC, c DESC, ve.code) AS place FROM ve JOIN fr USING (date, code) LEFT JOIN nd USING (date, code)) "
    f"SELECT cc.date, cc.code, state, {rounded('risk_fraction reward_risk')}, front, n_dominators, place AS comparison_order, coalesce(place <= 3, FALSE) AS selected, coalesce(place <= 2, FALSE) AS in_two, CASE WHEN why <> '' THEN why WHEN place <= 3 THEN 'SELECTED' ELSE 'LIMIT_REACHED' END AS reasons FROM cc LEFT JOIN pl USING (date, code)",
)
def fronts_and_shortlist(spark, d):
    """Every candidate with its front, place and reasons; three places, and whether two would hold it."""
    x = fr.shortlist(candidates(spark, d), STAGE, 3)
    return x.select(
        "date", "code", "state", F.round("risk_fraction", 6).alias("risk_fraction"), F.round("reward_risk", 6).alias("reward_risk"), "front", "n_dominators", "comparison_order",
        "selected", F.coalesce(F.col("comparison_order") <= 2, F.lit(False)).alias("in_two"), F.concat_ws("|", "reasons").alias("reasons"),
    )
