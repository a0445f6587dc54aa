"""Queries for point-in-time features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlattice.operators import features as fx
from barlattice.sources import panel as P

from .registry import query
from .sql import FEATURES, STEP, W, f, g, rounded


def r6(df, columns: str, *keep: str):
    return df.select(*keep, *[F.round(F.col(c), 6).alias(c) for c in columns.split()])


A_COLUMNS = "ma5 ma20 vma20_prev vol_ratio_k chg1 chg5 chg10 chg20 bias20 llv250 hhv250 pos250 prev60_hi_c prev60_lo plat_range index_chg5 rs ud_ratio"


@query("o3_1_platform_features", f"WITH {P.BARS}, {P.INDEX}, {FEATURES} SELECT symbol, date, {rounded(A_COLUMNS)} FROM fe WHERE rn >= 120")
def platform_features(spark, d):
    panel = P.bars(spark, d)
    return r6(fx.platform_features(panel, P.index_bars(panel)).where("rn >= 120"), A_COLUMNS, "symbol", "date")


PROFILE_SQL = """pw AS (SELECT s.signal_id, s.close AS c, b.high, b.low, b.close, b.volume FROM sig s JOIN nb b ON b.symbol = s.symbol AND b.rn BETWEEN s.rn - 119 AND s.rn),
pl AS (SELECT signal_id, min(low) AS lo, max(high) AS hi FROM pw GROUP BY 1),
pb AS (SELECT pw.signal_id, least(greatest(len(list_filter(range(0, 21), lambda e: lo + (hi - lo) * e / 20 <= close)) - 1, 0), 19) AS bin, sum(volume) AS volume FROM pw JOIN pl USING (signal_id) GROUP BY 1, 2),
pf AS (SELECT pl.signal_id, CAST(i AS INTEGER) AS bin, lo + (hi - lo) * i / 20 AS edge, coalesce(pb.volume, 0) AS volume FROM pl CROSS JOIN range(0, 20) AS t(i) LEFT JOIN pb ON pb.signal_id = pl.signal_id AND pb.bin = t.i),
pv AS (SELECT pf.signal_id, sum(CASE WHEN edge > close * 1.02 THEN volume ELSE 0 END) / sum(volume) AS overhang, arg_max(edge, (round(volume, 6), -bin)) FILTER (edge > close) AS vol_edge FROM pf JOIN sig USING (signal_id) GROUP BY 1)"""


@query("o3_2_volume_by_price", f"WITH {P.BARS}, {P.NUMBERED}, {P.SIGNALS}, {PROFILE_SQL} SELECT signal_id, bin, round(edge, 6) AS edge, round(volume, 6) AS volume FROM pf")
def volume_by_price(spark, d):
    panel = P.kept_bars(spark, d)
    x = fx.volume_profile(P.signal_bars(fx.with_profile(panel)).select("symbol", "signal_id", "rn", "profile_lo", "profile_hi"), panel)
    return r6(x.select("signal_id", F.inline("volumes")), "edge volume", "signal_id", "bin")


@query(
    "o3_3_overhang",
    f"WITH {P.BARS}, {P.NUMBERED}, {P.SIGNALS}, {PROFILE_SQL}, vb AS (SELECT symbol || ':' || CAST(date AS VARCHAR) AS signal_id, arg_min(low, (-volume, date)) {f(-9)} AS vol_bar_lo FROM bars) "
    "SELECT signal_id, round(overhang, 6) AS overhang, round(vol_edge, 6) AS vol_edge, round(vol_bar_lo, 6) AS vol_bar_lo FROM pv JOIN vb USING (signal_id)",
)
def overhang(spark, d):
    bars = P.kept_bars(spark, d)
    panel = bars.withColumn("vol_bar_lo", F.min_by("low", F.struct(-F.col("volume"), F.col("date"))).over(fx.back(-9)))
    x = P.signal_bars(fx.with_profile(panel)).select("symbol", "signal_id", "close", "vol_bar_lo", "rn", "profile_lo", "profile_hi")
    return r6(fx.profile_levels(fx.volume_profile(x, bars)), "overhang vol_edge vol_bar_lo", "signal_id")


@query(
    "o3_4_match_projection",
    f"WITH {P.BARS}, {P.INDEX}, {FEATURES} SELECT symbol, date, (plat_range <= 0.30) AS c_range, (close > prev60_hi_c) AS c_breakout, (vol_ratio_k >= 1.8) AS c_volume, (chg1 >= 3) AS c_change, (close > ma20) AS c_ma20, "
    "lead(date) OVER (PARTITION BY symbol ORDER BY date) AS next_bar FROM fe QUALIFY rn >= 120",
)
def match_projection(spark, d):
    df = fx.platform_features(P.bars(spark, d)).withColumn("next_bar", F.lead("date").over(fx.by_symbol())).where("rn >= 120")
    return df.selectExpr("symbol", "date", "plat_range <= 0.30 AS c_range", "close > prev60_hi_c AS c_breakout", "vol_ratio_k >= 1.8 AS c_volume", "chg1 >= 3 AS c_change", "close > ma20 AS c_ma20", "next_bar")


RISK_SQL = f"""rk0 AS (SELECT *, row_number() {W} AS rn, (close / lag(close) {W} - 1) * 100 AS ret FROM bars),
rk AS (SELECT symbol, date, rn, close, volume, CASE WHEN rn > 20 THEN close / lag(close, 20) {W} - 1 END AS r20, CASE WHEN rn > 60 THEN close / lag(close, 60) {W} - 1 END AS r60,
  CASE WHEN rn > 20 THEN stddev_samp(ret) {f(-19)} END AS vol20, CASE WHEN rn >= 20 THEN quantile_cont(turnover, 0.5) {f(-19)} END AS med_turnover20 FROM rk0)"""


@query("o3_5_return_and_risk", f"WITH {P.BARS}, {RISK_SQL} SELECT symbol, date, {rounded('r20 r60 vol20 med_turnover20')} FROM rk WHERE rn >= 61")
def return_and_risk(spark, d):
    return r6(fx.returns_and_risk(P.bars(spark, d)).where("rn >= 61"), "r20 r60 vol20 med_turnover20", "symbol", "date")


COMPRESSION_SQL = f"""cp0 AS (SELECT *, row_number() {W} AS rn, lag(close) {W} AS pc FROM bars),
cp1 AS (SELECT *, CASE WHEN pc > 0 THEN greatest(high - low, abs(high - pc), abs(low - pc)) / pc * 100 END AS tr FROM cp0),
cp2 AS (SELECT symbol, date, close, rn, tr, avg(tr) {f(-10, -1)} AS tr10, avg(tr) {f(-50, -11)} AS tr40, max(high) {f(-20, -1)} AS prior_high20, lag(close, 1) {W} / lag(close, 21) {W} - 1 AS prior_r20 FROM cp1),
cp AS (SELECT *, CASE WHEN rn >= 52 THEN tr10 / nullif(tr40, 0) END AS ratio FROM cp2)"""


@query("o3_6_compression", f"WITH {P.BARS}, {COMPRESSION_SQL} SELECT symbol, date, {rounded('tr tr10 tr40 ratio prior_high20 prior_r20')} FROM cp WHERE rn >= 52")
def compression(spark, d):
    return r6(fx.compression_features(P.bars(spark, d)).where("rn >= 52"), "tr tr10 tr40 ratio prior_high20 prior_r20", "symbol", "date")


REVERSAL_SQL = f"""rv0 AS (SELECT *, row_number() {W} AS rn, (close / lag(close) {W} - 1) * 100 AS ret FROM bars),
rv AS (SELECT * FROM (SELECT symbol, date, close, rn, lag(close, 1) {W} / lag(close, 21) {W} - 1 AS r20_pre, lag(close) {W} AS prev_close, close / lag(close) {W} - 1 AS t_day_return, max(close) {f(-5, -1)} AS prior_close_high5,
  close / max(close) {f(-5, -1)} - 1 AS reclaim_margin, min(low) {f(-4)} AS min_low5, stddev_samp(ret) {f(-20, -1)} AS vol20_pre, quantile_cont(volume, 0.5) {f(-19)} AS median_volume20 FROM rv0) WHERE rn >= 22)"""
REVERSAL_COLUMNS = "r20_pre t_day_return prior_close_high5 reclaim_margin min_low5 vol20_pre median_volume20"


@query("o3_7_reversal_features", f"WITH {P.BARS}, {REVERSAL_SQL} SELECT symbol, date, {rounded(REVERSAL_COLUMNS)} FROM rv")
def reversal(spark, d):
    return r6(fx.reversal_features(P.bars(spark, d)), REVERSAL_COLUMNS, "symbol", "date")


TREND_SQL = f"""tr0 AS (SELECT *, row_number() {W} AS rn, ln(close) AS lnc, CASE WHEN close > lag(close) {W} THEN 1.0 WHEN lag(close) {W} IS NOT NULL THEN 0.0 END AS rise FROM bars),
tr1 AS (SELECT symbol, date, close, rn, avg(close) {f(-19)} AS sma_fast, avg(close) {f(-59)} AS sma_slow, regr_slope(lnc, CAST(rn AS DOUBLE)) {f(-59)} AS log_slope, avg(rise) {f(-58)} AS up_fraction FROM tr0),
trd AS (SELECT *, (close > sma_slow AND sma_fast > sma_slow AND log_slope > 0 AND up_fraction >= 0.55) AS trend_ok FROM tr1 WHERE rn >= 60)"""


@query("o3_8_trend", f"WITH {P.BARS}, {TREND_SQL} SELECT symbol, date, {rounded('sma_fast sma_slow log_slope up_fraction')}, trend_ok FROM trd")
def trend(spark, d):
    return r6(fx.trend_features(P.bars(spark, d)), "sma_fast sma_slow log_slope up_fraction", "symbol", "date", "trend_ok")


GEOMETRY_SQL = f"""ge0 AS (SELECT *, lag(close) {W} AS pc FROM bars),
ge AS (SELECT symbol, date, close, high, volume, close / open - 1 AS body_return, CASE WHEN high > low THEN abs(close - open) / (high - low) ELSE 0 END AS body_fraction, (high - low) / pc AS range_return,
  CASE WHEN high > low THEN (close - low) / (high - low) ELSE 1 END AS close_location, CASE WHEN high > low THEN (high - greatest(open, close)) / (high - low) ELSE 0 END AS upper_shadow,
  CASE WHEN high > low THEN (least(open, close) - low) / (high - low) ELSE 0 END AS lower_shadow FROM ge0)"""
GEOMETRY_COLUMNS = "body_return body_fraction range_return close_location upper_shadow lower_shadow"


@query("o3_9_bar_geometry", f"WITH {P.BARS}, {GEOMETRY_SQL} SELECT symbol, date, {rounded(GEOMETRY_COLUMNS)} FROM ge")
def geometry(spark, d):
    return r6(fx.geometry(P.bars(spark, d)), GEOMETRY_COLUMNS, "symbol", "date")


RELVOL_SQL = f"""ra0 AS (SELECT symbol, date, volume, row_number() {W} AS rn, list(volume) {f(-20, -1)} AS past FROM bars),
ra1 AS (SELECT *, list_aggregate(past, 'median') AS med FROM ra0), ra2 AS (SELECT *, list_aggregate(list_transform(past, lambda x: abs(x - med)), 'median') AS mad FROM ra1),
ra AS (SELECT symbol, date, CASE WHEN rn > 20 AND med > 0 THEN volume / med END AS median_ratio, CASE WHEN rn > 20 AND mad > 0 THEN (volume - med) / (1.4826::DOUBLE * mad) END AS robust_z,
  CASE WHEN rn <= 20 THEN 'INSUFFICIENT_HISTORY' WHEN med <= 0 THEN 'ZERO_BASELINE' WHEN mad <= 0 THEN 'ZERO_DISPERSION' ELSE 'AVAILABLE' END AS status FROM ra2)"""


@query("o3_10_robust_volume", f"WITH {P.BARS}, {RELVOL_SQL} SELECT symbol, date, {rounded('median_ratio robust_z')}, status FROM ra")
def robust_volume(spark, d):
    return r6(fx.relative_volume(P.bars(spark, d)), "median_ratio robust_z", "symbol", "date", "status")


PULLBACK_SQL = f"""pb0 AS (SELECT symbol, date, rn, sum(down_v) {f(-9)} AS dv, sum(volume) {f(-9)} AS tv, avg(up_v) {f(-9)} AS ua, avg(down_v) {f(-9)} AS da, avg(volume) {f(-9, -5)} AS h1, avg(volume) {f(-4)} AS h2, count(up_v) {f(-9)} AS un, count(down_v) {f(-9)} AS dn FROM st2)"""


def pullback_features(panel):
    """Volume of the last ten bars: share on falling bars, rising against falling mean, second half against first."""
    base = P.numbered(panel).withColumn("pc", F.lag("close").over(fx.by_symbol()))
    base = base.withColumn("up_v", F.when(F.col("close") > F.col("pc"), F.col("volume"))).withColumn("down_v", F.when(F.col("close") < F.col("pc"), F.col("volume")))
    w = fx.back(-9)
    return base.select(
        "symbol", "date", "rn", F.try_divide(F.coalesce(F.sum("down_v").over(w), F.lit(0.0)), F.sum("volume").over(w)).alias("down_volume_share"), F.try_divide(F.avg("up_v").over(w), F.avg("down_v").over(w)).alias("up_down_mean_ratio"),
        F.try_divide(F.avg("volume").over(fx.back(-4)), F.avg("volume").over(fx.back(-9, -5))).alias("half_mean_decay"),
        F.when(F.count("up_v").over(w) == 0, "NO_UP_SESSIONS").when(F.count("down_v").over(w) == 0, "NO_DOWN_SESSIONS").alias("ratio_reason"),
    ).where("rn >= 30")


@query(
    "o3_13_relative_volume",
    f"WITH {P.BARS}, x AS (SELECT symbol, date, volume, count(volume) {f(-20, -1)} AS n, avg(volume) {f(-20, -1)} AS m FROM bars) "
    "SELECT symbol, date, CASE WHEN n = 20 AND m > 0 THEN round(volume / m, 6) END AS relative_volume, CASE WHEN n < 20 THEN 'INSUFFICIENT_HISTORY' WHEN m <= 0 THEN 'NON_POSITIVE_BASELINE' END AS reason FROM x",
)
def relative_volume(spark, d):
    w = fx.back(-20, -1)
    x = P.bars(spark, d).select("symbol", "date", "volume", F.count("volume").over(w).alias("n"), F.avg("volume").over(w).alias("m"))
    value = F.when((F.col("n") == 20) & (F.col("m") > 0), F.round(F.col("volume") / F.col("m"), 6))
    return x.select("symbol", "date", value.alias("relative_volume"), F.when(F.col("n") < 20, "INSUFFICIENT_HISTORY").when(F.col("m") <= 0, "NON_POSITIVE_BASELINE").alias("reason"))


REGIME_SQL = f"""rg0 AS (SELECT *, row_number() OVER (ORDER BY date) AS n, (close / lag(close) OVER (ORDER BY date) - 1) * 100 AS ret FROM idx),
rg1 AS (SELECT date, close, n, avg(close) {g(-19)} AS ma20, avg(close) {g(-59)} AS ma60, (close / lag(close, 5) OVER (ORDER BY date) - 1) * 100 AS ret5, (close / lag(close, 20) OVER (ORDER BY date) - 1) * 100 AS ret20, stddev_samp(ret) {g(-19)} AS vol20 FROM rg0),
rg AS (SELECT *, (close / ma20 - 1) * 100 AS vs_ma20, (close / ma60 - 1) * 100 AS vs_ma60, CASE WHEN close > ma20 AND ma20 > ma60 THEN 'TREND_UP' WHEN close < ma20 AND ma20 < ma60 THEN 'TREND_DOWN' ELSE 'TREND_NEUTRAL' END AS trend,
  CASE WHEN vol20 < 1.0 THEN 'VOL_LOW' WHEN vol20 >= 2.0 THEN 'VOL_HIGH' ELSE 'VOL_NORMAL' END AS volatility FROM rg1 WHERE n >= 61)"""


@query("o3_14_market_regime", f"WITH {P.BARS}, {P.INDEX}, {REGIME_SQL} SELECT date, {rounded('vs_ma20 vs_ma60 ret5 ret20 vol20')}, trend, volatility FROM rg")
def market_regime(spark, d):
    return r6(fx.regime(P.index_bars(P.bars(spark, d))), "vs_ma20 vs_ma60 ret5 ret20 vol20", "date", "trend", "volatility")


@query(
    "o3_15_market_grade",
    f"""WITH {P.BARS}, {P.INDEX}, x AS (SELECT date, close, row_number() OVER (ORDER BY date) AS n, avg(close) {g(-4)} AS ma5, avg(close) {g(-19)} AS ma20, (close / lag(close, 5) OVER (ORDER BY date) - 1) * 100 AS chg5, volume / nullif(avg(volume) {g(-20, -1)}, 0) AS vr FROM idx),
y AS (SELECT date, CAST(3 * CAST(close >= ma5 AS INTEGER) + 3 * CAST(close >= ma20 AS INTEGER) + CAST(chg5 > 0 AS INTEGER) + CAST(vr >= 0.8 AS INTEGER) AS INTEGER) AS points FROM x WHERE n >= 21)
SELECT date, points, CASE WHEN points >= 6 THEN 'A' WHEN points >= 4 THEN 'B' ELSE 'C' END AS grade FROM y""",
)
def market_grade(spark, d):
    return fx.market_grade(P.index_bars(P.bars(spark, d))).select("date", "points", "grade")


# Two style series: the mean closes of the 60 and the 30 boards.
PAIR_SQL = f"""pa AS (SELECT date, avg(close) FILTER (symbol LIKE '60%') AS a, avg(close) FILTER (symbol LIKE '30%') AS b FROM bars GROUP BY date),
pr1 AS (SELECT date, a / b AS ratio FROM pa WHERE a IS NOT NULL AND b IS NOT NULL),
pair AS (SELECT date, ratio, (ratio / lag(ratio, 20) OVER (ORDER BY date) - 1) * 100 AS chg20, (ratio / lag(ratio, 5) OVER (ORDER BY date) - 1) * 100 AS chg5, (ratio / lag(ratio, 4) OVER (ORDER BY date) - 1) * 100 AS chg4 FROM pr1)"""


def pair_series(panel):
    """Ratio of two index series on the dates that both have, and its changes."""
    a = panel.where("symbol LIKE '60%'").groupBy("date").agg(F.avg("close").alias("a"))
    b = panel.where("symbol LIKE '30%'").groupBy("date").agg(F.avg("close").alias("b"))
    w = Window.orderBy("date")
    r = a.join(b, "date").select("date", (F.col("a") / F.col("b")).alias("ratio"))
    return r.select("date", "ratio", *[fx.pct(F.col("ratio"), F.lag("ratio", n).over(w)).alias(f"chg{n}") for n in (20, 5, 4)])


@query("o3_17_pair_ratio", f"WITH {P.BARS}, {PAIR_SQL} SELECT date, {rounded('ratio chg20 chg5 chg4')}, CASE WHEN chg20 > 0 THEN 'UP' WHEN chg20 < 0 THEN 'DOWN' WHEN chg20 = 0 THEN 'FLAT' END AS direction FROM pair")
def pair_ratio(spark, d):
    x = pair_series(P.bars(spark, d))
    return r6(x.withColumn("direction", F.when(F.col("chg20") > 0, "UP").when(F.col("chg20") < 0, "DOWN").when(F.col("chg20") == 0, "FLAT")), "ratio chg20 chg5 chg4", "date", "direction")


BREAKOUT_SQL = f"""bk0 AS (SELECT *, max(close) {f(-60, -1)} AS base_hi, min(low) {f(-60, -1)} AS base_lo, coalesce(volume / nullif(avg(volume) {f(-20, -1)}, 0), 0) AS vr, (close / lag(close) {W} - 1) * 100 AS chg1 FROM nb),
bk1 AS (SELECT *, (rn >= 62 AND close > base_hi AND vr >= 1.8 AND chg1 >= 3) AS flag FROM bk0),
bk2 AS (SELECT *, first_value(CASE WHEN flag THEN {{'rn': rn, 'base_hi': base_hi, 'base_lo': base_lo, 'vr': vr, 'close': close, 'volume': volume, 'low': low, 'date': date}} END IGNORE NULLS) {f(-14, -1)} AS bo0 FROM bk1),
bk AS (SELECT *, CASE WHEN least(rn, 260) - 1 + (bo0.rn - rn) >= 61 THEN bo0 END AS bo FROM bk2)"""

# The bars from the breakout to the one before, one row each.
SINCE_SQL = f"""tb AS (SELECT symbol, date, rn, high, low, close, volume, bo, lag(close) {W} AS pc, avg(close) {f(-4)} AS ma5x FROM bk), tt AS (SELECT * FROM tb WHERE bo IS NOT NULL),
tp AS (SELECT tt.symbol, tt.date, b.rn AS p, b.high AS p_high, b.low AS p_low, b.volume AS p_volume, tt.bo.rn AS brn FROM tt JOIN nb b ON b.symbol = tt.symbol AND b.rn >= tt.bo.rn AND b.rn < tt.rn)"""


@query(
    "o3_16_structure_proxy",
    f"WITH {P.BARS}, {P.NUMBERED}, {BREAKOUT_SQL}, {SINCE_SQL}, h AS (SELECT symbol, date, max(p_high) AS h1, arg_min(p, (-p_high, p)) AS h_at FROM tp GROUP BY 1, 2), l AS (SELECT tp.symbol, tp.date, min(p_low) AS l2 FROM tp JOIN h USING (symbol, date) WHERE p > h_at GROUP BY 1, 2), "
    "z AS (SELECT tt.symbol, tt.date, bo.base_lo AS l0, h1, l2, CASE WHEN bo.base_lo < l2 AND l2 < h1 THEN (close - l2) / (h1 - l2) END AS recovery FROM tt JOIN h USING (symbol, date) LEFT JOIN l USING (symbol, date)) "
    f"SELECT symbol, date, {rounded('l0 h1 l2 recovery')}, CASE WHEN recovery IS NULL THEN 'INVALID' WHEN recovery < 0.5 THEN 'EARLY' WHEN recovery <= 1.0 THEN 'RECOVERING' ELSE 'EXTENDED' END AS state, CASE WHEN l2 IS NULL THEN 'NO_COMPLETE_POST_H1_PULLBACK_DAY' WHEN recovery IS NULL THEN 'INVALID_L0_L2_H1_ORDER_OR_DENOMINATOR' END AS reason FROM z",
)
def structure_proxy(spark, d):
    return structure_of(P.bars(spark, d))


def structure_of(panel):
    return r6(fx.structure_proxy(panel), "l0 h1 l2 recovery", "symbol", "date", "state", "reason")


@query(
    "o3_12_pullback_observation",
    f"WITH {P.BARS}, {P.NUMBERED}, {BREAKOUT_SQL}, lc AS (SELECT symbol, rn, volume, close > lag(close) {W} AS up, close < lag(close) {W} AS down FROM nb), tt AS (SELECT symbol, date, rn, bo.rn AS brn FROM bk WHERE bo IS NOT NULL), "
    "g AS (SELECT tt.symbol, tt.date, count(lc.volume) AS n, sum(volume) AS total, sum(volume) FILTER (down) AS dv, avg(volume) FILTER (up) AS ua, avg(volume) FILTER (down) AS da, avg(volume) FILTER (lc.rn - brn <= (tt.rn - 1 - brn) // 2) AS h1, avg(volume) FILTER (lc.rn - brn > (tt.rn - 1 - brn) // 2) AS h2 FROM tt LEFT JOIN lc ON lc.symbol = tt.symbol AND lc.rn > brn AND lc.rn < tt.rn GROUP BY 1, 2) "
    "SELECT symbol, date, n AS window_days, round(coalesce(dv, 0) / total, 6) AS down_volume_share, round(ua / da, 6) AS up_down_volume_ratio, CASE WHEN n >= 4 THEN round(h2 / h1, 6) END AS decay_ratio, CASE WHEN n = 0 THEN 'NO_PULLBACK_WINDOW' END AS share_reason, CASE WHEN n = 0 THEN 'NO_PULLBACK_WINDOW' WHEN ua IS NULL OR da IS NULL THEN 'NO_UP_OR_DOWN_DAY' END AS ratio_reason, CASE WHEN n = 0 THEN 'NO_PULLBACK_WINDOW' WHEN n < 4 THEN 'PULLBACK_WINDOW_LT_4' END AS decay_reason FROM g",
)
def pullback_observation(spark, d):
    return observation_of(P.bars(spark, d))


def observation_of(panel):
    columns = "down_volume_share up_down_volume_ratio decay_ratio"
    return r6(fx.pullback_observation(panel), columns, "symbol", "date", "window_days", "share_reason", "ratio_reason", "decay_reason")


TRACE_COLUMNS = "base_hi breakout_volume_ratio pull_volume_ratio retest_volume_ratio reactivation_vs_retest reactivation_vs_breakout day_position distance_from_base_pct"


@query(
    "o3_18_breakout_trace",
    f"WITH {P.BARS}, {P.NUMBERED}, {BREAKOUT_SQL}, {SINCE_SQL}, r AS (SELECT symbol, date, sum(p_volume) FILTER (p > brn) AS held, count(*) FILTER (p > brn) AS n FROM tp GROUP BY 1, 2), "
    "y AS (SELECT tt.*, rn - bo.rn AS age, CASE WHEN n > 0 THEN held / n END AS retest, (coalesce(held, 0) + volume) / (rn - bo.rn) AS pull FROM tt JOIN r USING (symbol, date)), "
    "z AS (SELECT *, (close >= bo.base_hi * 0.97 AND (abs(close / bo.base_hi - 1) <= 0.04 OR close BETWEEN bo.base_hi * 0.97 AND bo.base_hi * 1.04)) AS a, pull < bo.volume * 0.7 AS b, (close >= pc OR close >= ma5x) AS c FROM y), "
    "o AS (SELECT symbol, date, bo.date AS breakout_date, age, CASE WHEN a AND b AND c THEN 'PULLBACK_ALL_PASS' WHEN NOT b AND a AND c THEN 'PULLBACK_VOLUME_FAIL_ONLY' WHEN NOT c AND a AND b THEN 'PULLBACK_TURN_STRENGTH_FAIL_ONLY' WHEN NOT a AND b AND c THEN 'PULLBACK_PRICE_STRUCTURE_FAIL' ELSE 'PULLBACK_MULTIPLE_FAIL' END AS stage, "
    "bo.base_hi AS base_hi, bo.vr AS breakout_volume_ratio, pull / bo.volume AS pull_volume_ratio, retest / bo.volume AS retest_volume_ratio, volume / nullif(retest, 0) AS reactivation_vs_retest, volume / bo.volume AS reactivation_vs_breakout, CASE WHEN high > low THEN (close - low) / (high - low) END AS day_position, (close / bo.base_hi - 1) * 100 AS distance_from_base_pct FROM z) "
    f"SELECT symbol, date, breakout_date, age, stage, {rounded(TRACE_COLUMNS)} FROM o",
)
def breakout_trace(spark, d):
    return r6(fx.breakout_trace(P.bars(spark, d)), TRACE_COLUMNS, "symbol", "date", "breakout_date", "age", "stage")


@query(
    "o3_19_breakout_episode",
    f"WITH {P.BARS}, {P.NUMBERED}, {BREAKOUT_SQL} SELECT symbol, bo.date AS breakout_date, sha256(symbol || '|' || CAST(bo.date AS VARCHAR)) AS episode_id, min(date) AS first_seen, count(*) AS bars_seen FROM bk WHERE bo IS NOT NULL GROUP BY 1, 2, 3",
)
def breakout_episode(spark, d):
    x = fx.first_breakout(P.bars(spark, d)).where("bo IS NOT NULL").select("symbol", "date", F.col("bo.date").alias("breakout_date"))
    key = F.sha2(F.concat_ws("|", "symbol", F.col("breakout_date").cast("string")), 256)
    return x.groupBy("symbol", "breakout_date").agg(F.min("date").alias("first_seen"), F.count(F.lit(1)).alias("bars_seen")).withColumn("episode_id", key)
