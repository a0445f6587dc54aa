"""Queries for predicates and gates (o4), levels and scores (o10.11, o10.12)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlattice.operators import features as fx
from barlattice.operators import patterns as pt
from barlattice.sources import panel as P

from .q_features import BREAKOUT_SQL, COMPRESSION_SQL, GEOMETRY_SQL, PROFILE_SQL, RELVOL_SQL, REVERSAL_SQL, TREND_SQL, r6
from .registry import query
from .sql import FEATURES, W, f, rounded

B = P.BARS
CONDITIONS = {
    "PLATFORM_RANGE": "plat_range <= 0.30",
    "CLOSE_ABOVE_PRIOR_HIGH": "close > prev60_hi_c",
    "VOLUME_EXPANSION": "vol_ratio_k >= 1.8",
    "DAY_CHANGE": "chg1 >= 3",
    "ABOVE_MA20": "close > ma20",
}
MATCHED = "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in CONDITIONS.items()) + ")"
FAILED = "concat_ws('|', " + ", ".join(f"CASE WHEN NOT coalesce({c}, FALSE) THEN '{n}' END" for n, c in CONDITIONS.items()) + ")"
ALL = " AND ".join(CONDITIONS.values())


def features_of(spark, d, index=False):
    panel = P.bars(spark, d)
    return fx.platform_features(panel, P.index_bars(panel) if index else None)


@query("o4_1_platform_match", f"WITH {B}, {P.INDEX}, {FEATURES} SELECT symbol, date, ({ALL}) AS matched, {MATCHED} AS matched_conditions, {FAILED} AS failed_conditions FROM fe WHERE rn >= 120")
def platform_match(spark, d):
    x = pt.platform_match(features_of(spark, d)).where("rn >= 120")
    return x.select("symbol", "date", "matched", F.concat_ws("|", "matched_conditions").alias("matched_conditions"), F.concat_ws("|", "failed_conditions").alias("failed_conditions"))


RETEST = f"""rt0 AS (SELECT *, avg(close) {f(-4)} AS ma5x, lag(close) {W} AS pc, list(volume) {f(-13)} AS recent FROM bk),
rt1 AS (SELECT *, CASE WHEN bo IS NOT NULL THEN list_sum(recent[len(recent) - (rn - bo.rn) + 1:]) / (rn - bo.rn) END AS pull_v FROM rt0 WHERE bo IS NOT NULL),
rt AS (SELECT symbol, date, rn, close, volume, bo, close >= bo.base_hi * 0.97 AS t1, (abs(close / bo.base_hi - 1) <= 0.04 OR (close >= bo.base_hi * 0.97 AND close <= bo.base_hi * 1.04)) AS t2, pull_v < bo.volume * 0.7 AS t3, (close >= pc OR close >= ma5x) AS t4 FROM rt1)"""


@query(
    "o4_2_retest_match",
    f"WITH {B}, {P.NUMBERED}, {BREAKOUT_SQL}, {RETEST} SELECT symbol, date, bo.date AS breakout_date, (rn >= 120 AND t1 AND t2 AND t3 AND t4) AS matched, concat_ws('|', CASE WHEN NOT t1 THEN 'PULLBACK_CLOSE_GE_97_PCT_BASE' END, CASE WHEN NOT t2 THEN 'PULLBACK_WITHIN_PLATFORM_4_PCT' END, CASE WHEN NOT t3 THEN 'PULLBACK_VOLUME_LT_70_PCT_BREAKOUT' END, CASE WHEN NOT t4 THEN 'PULLBACK_TURNED_STRONG' END) AS failed_tests FROM rt",
)
def retest_match(spark, d):
    x = pt.retest_match(P.bars(spark, d)).where("bo IS NOT NULL")
    return x.select("symbol", "date", F.col("bo.date").alias("breakout_date"), "matched", F.concat_ws("|", "failed_tests").alias("failed_tests"))


LEVELS = f"""lv0 AS (SELECT fe.*, sig.signal_id, overhang, vol_edge, sr.sector_rank, sr.sector_chg FROM sig JOIN fe ON fe.symbol = sig.symbol AND fe.date = sig.signal_date JOIN pv USING (signal_id) LEFT JOIN sec ON sec.symbol = fe.symbol LEFT JOIN sr ON sr.sector = sec.sector AND sr.date = fe.date),
lv1 AS (SELECT *, list_max(list_filter([ma20, prev60_hi_c, vol_bar_lo, min_low20], lambda s: s < close)) AS support, list_min(list_filter([max_high60, vol_edge, max_high120], lambda p: p > close * 1.03)) AS pressure FROM lv0),
lv2 AS (SELECT *, round(support * 0.98, 2) AS stop FROM lv1), lv3 AS (SELECT *, (close - stop) / close AS risk FROM lv2),
lv4 AS (SELECT *, CASE WHEN pressure IS NOT NULL THEN 'PRESSURE' ELSE 'TREND_2_5R' END AS target_type, coalesce(pressure, close * (1 + 2.5 * risk)) AS target FROM lv3),
lv AS (SELECT *, (target - close) / nullif(close - stop, 0) AS rr, round(greatest(prev60_hi_c, ma5), 2) AS trigger FROM lv4)"""
LEVELS_WITH = f"WITH {B}, {P.NUMBERED}, {P.INDEX}, {FEATURES}, {P.SIGNALS}, {PROFILE_SQL}, {P.SECTORS}, {P.SECTOR_RANKS}, {LEVELS}"


def signal_levels(spark, d):
    """Signals with features, volume profile, sector and levels: one row per signal."""
    panel = P.kept_bars(spark, d)
    member = P.sectors(spark, d)
    x = P.signal_bars(fx.with_profile(fx.platform_features(panel).drop("rn")))
    x = fx.profile_levels(fx.volume_profile(x, panel)).drop("volumes")
    x = fx.with_index(x, P.index_bars(panel))
    x = x.join(member, "symbol", "left").join(P.sector_ranks(panel, member), ["date", "sector"], "left")
    return pt.levels(x)


REJECT = """CASE WHEN close <= 2 THEN 'PRICE_TOO_LOW' WHEN chg10 > 35 AND bias20 > 15 THEN 'OVERHEATED_10D' WHEN pos250 > 0.9 AND chg20 > 40 THEN 'EXTENDED_20D' WHEN support IS NULL THEN 'NO_VALID_SUPPORT'
WHEN risk <= 0 OR risk > 0.09 THEN 'RISK_OUT_OF_RANGE' WHEN rr IS NULL OR rr < 2 THEN 'REWARD_TOO_SMALL' WHEN overhang > 0.5 AND rr < 2.5 THEN 'OVERHANG' END"""


@query("o4_3_reject_gates", f"{LEVELS_WITH} SELECT signal_id, {REJECT} AS reject_reason, CASE WHEN NOT coalesce({ALL}, FALSE) THEN 'NOT_MATCHED' WHEN {REJECT} IS NOT NULL THEN 'MATCHED_REJECTED' ELSE 'QUALIFIED_LEGACY_BASELINE' END AS status FROM lv")
def reject_gates(spark, d):
    x = pt.platform_match(signal_levels(spark, d)).withColumn("reject_reason", pt.first_reject())
    status = F.when(~F.col("matched"), pt.NOT_MATCHED).when(F.col("reject_reason").isNotNull(), pt.REJECTED).otherwise(pt.QUALIFIED)
    return x.select("signal_id", "reject_reason", status.alias("status"))


VCB = f"""vc0 AS (SELECT *, close > prior_high20 AS is_breakout FROM cp WHERE ratio IS NOT NULL), vc AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ratio, symbol) AS rk, count(*) OVER (PARTITION BY date) AS n FROM vc0)"""


@query(
    "o4_4_compression_breakout",
    f"WITH {B}, {COMPRESSION_SQL}, {VCB} SELECT symbol, date, CAST(rk AS BIGINT) AS ratio_rank, CASE WHEN NOT is_breakout THEN 'NONE' WHEN ratio < 1 AND rk <= ceil(0.2 * n) THEN 'CANDIDATE' ELSE 'CONTROL' END AS class FROM vc",
)
def compression_breakout(spark, d):
    x = fx.compression_features(P.bars(spark, d)).where("ratio IS NOT NULL")
    w = Window.partitionBy("date")
    x = x.withColumn("rk", F.row_number().over(w.orderBy("ratio", "symbol"))).withColumn("n", F.count(F.lit(1)).over(w))
    strong = (F.col("ratio") < 1) & (F.col("rk") <= F.ceil(0.2 * F.col("n")))
    return x.select("symbol", "date", F.col("rk").cast("long").alias("ratio_rank"), F.when(~(F.col("close") > F.col("prior_high20")), "NONE").when(strong, "CANDIDATE").otherwise("CONTROL").alias("class"))


RVC = "rvk AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY r20_pre, symbol) AS rk, count(*) OVER (PARTITION BY date) AS n FROM rv), rvc AS (SELECT *, (rk <= ceil(0.2 * n) AND r20_pre < 0) AS downside, close > prev_close AS bounce, close > prior_close_high5 AS reclaim FROM rvk)"


@query("o4_5_reversal_classes", f"WITH {B}, {REVERSAL_SQL}, {RVC} SELECT symbol, date, downside, bounce, reclaim, CASE WHEN NOT downside THEN 'OUTSIDE' WHEN bounce AND reclaim THEN 'CANDIDATE' WHEN bounce THEN 'PRIMARY_CONTROL' ELSE 'BASELINE' END AS class FROM rvc")
def reversal_classes(spark, d):
    return reversal_classified(P.bars(spark, d)).select("symbol", "date", "downside", "bounce", "reclaim", "class")


def reversal_classified(panel):
    w = Window.partitionBy("date")
    x = fx.reversal_features(panel)
    x = x.withColumn("rk", F.row_number().over(w.orderBy("r20_pre", "symbol"))).withColumn("n", F.count(F.lit(1)).over(w))
    x = x.withColumn("downside", (F.col("rk") <= F.ceil(0.2 * F.col("n"))) & (F.col("r20_pre") < 0)).withColumn("bounce", F.col("close") > F.col("prev_close")).withColumn("reclaim", F.col("close") > F.col("prior_close_high5"))
    return x.withColumn("class", F.when(~F.col("downside"), "OUTSIDE").when(F.col("bounce") & F.col("reclaim"), "CANDIDATE").when(F.col("bounce"), "PRIMARY_CONTROL").otherwise("BASELINE"))


def after_signals(panel, bars: int):
    """Each signal with its next bars on the symbol's own clock, by an equality join on (symbol, place)."""
    b = P.numbered(panel).select("symbol", "rn", *[F.col(c).alias(f"b_{c}") for c in ("date", "open", "high", "low", "close")])
    s = P.signals(panel).withColumnRenamed("rn", "s_rn").withColumn("rn", F.explode(F.sequence(F.col("s_rn") + 1, F.col("s_rn") + bars)))
    return s.join(b, ["symbol", "rn"]).withColumn("step", (F.col("rn") - F.col("s_rn")).cast("long"))


BOARD = "CASE WHEN symbol LIKE '68%' THEN 'STAR' WHEN symbol LIKE '30%' THEN 'ChiNext' WHEN symbol LIKE '60%' OR symbol LIKE '00%' THEN 'Main' ELSE 'Unknown' END"


@query("o4_8_board_policy", f"WITH {B} SELECT {BOARD} AS board, count(DISTINCT symbol) AS n_symbols, count(*) AS n_bars, ({BOARD} <> 'STAR') AS retained FROM bars GROUP BY 1, 4")
def board_policy(spark, d):
    per = P.bars(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).withColumn("board", pt.board(F.col("symbol")))
    return per.groupBy("board").agg(F.count(F.lit(1)).alias("n_symbols"), F.sum("n").alias("n_bars")).withColumn("retained", F.col("board") != "STAR")


ST_NAME = "CASE WHEN c_custkey % 7 = 0 THEN ' *ST ' || c_name WHEN c_custkey % 11 = 0 THEN 'st' || c_name WHEN c_custkey % 13 = 0 THEN 'ST' ELSE c_name END"


@query("o4_9_special_treatment", f"WITH n AS (SELECT c_custkey, {ST_NAME} AS name FROM customer) SELECT c_custkey AS key, name, regexp_matches(upper(trim(name)), '^\\*?ST($|[^A-Z0-9])') AS is_st, regexp_matches(lower(trim(name)), '^\\*?st') AS has_prefix FROM n")
def special_treatment(spark, d):
    from barlattice.functions import scalars

    k, n = F.col("c_custkey"), F.col("c_name")
    name = F.when(k % 7 == 0, F.concat(F.lit(" *ST "), n)).when(k % 11 == 0, F.concat(F.lit("st"), n)).when(k % 13 == 0, "ST").otherwise(n)
    x = P.read(spark, d, "customer").select(k.alias("key"), name.alias("name"))
    return x.select("key", "name", scalars.is_special_treatment(F.col("name")).alias("is_st"), F.lower(F.trim("name")).rlike(r"^\*?st").alias("has_prefix"))


TRADE = "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 31 = 0 THEN 0 WHEN o_orderkey % 37 = 0 THEN NULL ELSE CAST(o_orderkey % 1000 + 1 AS DOUBLE) END AS volume"


@query("o4_10_trade_state", f"WITH q AS (SELECT o_orderkey, {TRADE} FROM orders) SELECT o_orderkey AS key, CASE WHEN price IS NULL OR volume IS NULL THEN 'UNKNOWN' WHEN volume = 0 THEN 'NO_TRADE' WHEN price > 0 AND volume > 0 THEN 'TRADED' ELSE 'UNKNOWN' END AS trade_state FROM q")
def trade_state(spark, d):
    from barlattice.functions import scalars

    k = F.col("o_orderkey")
    q = P.read(spark, d, "orders").select(k.alias("key"), F.when(k % 29 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 31 == 0, 0.0).when(k % 37 == 0, F.lit(None)).otherwise((k % 1000 + 1).cast("double")).alias("volume"))
    return q.select("key", scalars.trade_state(F.col("price"), F.col("volume")).alias("trade_state"))


@query("o4_11_price_limit_proxy", f"WITH {B}, x AS (SELECT symbol, date, (close / lag(close) {W} - 1) * 100 AS r FROM bars) SELECT symbol, date, CASE WHEN symbol LIKE '60%' OR symbol LIKE '00%' THEN abs(r) >= 9.5 WHEN symbol LIKE '30%' OR symbol LIKE '68%' THEN abs(r) >= 19.0 END AS near_limit FROM x WHERE r IS NOT NULL")
def price_limit_proxy(spark, d):
    x = P.bars(spark, d).select("symbol", "date", fx.pct(F.col("close"), F.lag("close").over(fx.by_symbol())).alias("r")).where("r IS NOT NULL")
    kind = pt.board(F.col("symbol"))
    return x.select("symbol", "date", F.when(kind == "Main", F.abs("r") >= 9.5).when(kind.isin("ChiNext", "STAR"), F.abs("r") >= 19.0).alias("near_limit"))


@query(
    "o4_12_snapshot_tolerance",
    f"WITH {B}, {P.NUMBERED}, s AS (SELECT symbol, date, close, close * (1 + CASE WHEN rn % 3 = 0 THEN 1e-6 WHEN rn % 3 = 1 THEN 1e-12 ELSE 0 END) AS quote, volume, rn FROM nb) "
    "SELECT symbol, date, abs(close - quote) <= greatest(1e-9 * greatest(abs(close), abs(quote)), 1e-8) AS same, CASE WHEN abs(close - quote) > greatest(1e-9 * greatest(abs(close), abs(quote)), 1e-8) THEN 'CLOSE_MISMATCH' END AS reason FROM s",
)
def snapshot_tolerance(spark, d):
    from barlattice.functions import scalars

    shift = F.when(F.col("rn") % 3 == 0, 1e-6).when(F.col("rn") % 3 == 1, 1e-12).otherwise(0.0)
    x = P.numbered(P.bars(spark, d)).withColumn("quote", F.col("close") * (1 + shift))
    same = scalars.near(F.col("close"), F.col("quote"))
    return x.select("symbol", "date", same.alias("same"), F.when(~same, "CLOSE_MISMATCH").alias("reason"))


#: Fixed values of the eight gates, in their order.
GATES = {"manifest_parity": "parity", "event_count_minimum": "events >= 30", "available_events_per_horizon": "least_available >= 30", "primary_positive_rate": "positive >= 0.5", "primary_mean_return": "mean > 0", "primary_median_return": "med > 0", "year_count": "robust >= 3", "positive_mean_year_count": "good >= 2"}
DECISION = f"""jo AS (SELECT out.*, sig.signal_id FROM out JOIN sig ON sig.symbol = out.symbol AND sig.signal_date = out.date),
m AS (SELECT count(*) AS events, least(count(ret1), count(ret3), count(ret5), count(ret10)) AS least_available, avg(CAST(ret10 > 0 AS INTEGER)) AS positive, avg(ret10) AS mean, median(ret10) AS med, count(*) = (SELECT count(*) FROM sig) AND count(DISTINCT signal_id) = count(*) AND count(ret10) <= count(ret5) AND count(ret5) <= count(ret3) AND count(ret3) <= count(ret1) AS parity FROM jo),
y AS (SELECT year(date) AS y, count(ret10) AS n, avg(ret10) AS mean FROM jo GROUP BY 1), yy AS (SELECT count(*) FILTER (n >= 10) AS robust, count(*) FILTER (n >= 10 AND mean > 0) AS good FROM y)"""


@query(
    "o4_13_eligibility_decision",
    f"WITH {B}, {P.NUMBERED}, {P.SIGNALS}, {P.OUTCOMES}, {DECISION}, g AS (SELECT least_available, concat_ws('|', {', '.join(f'CASE WHEN NOT coalesce({c}, FALSE) THEN {chr(39)}{n}{chr(39)} END' for n, c in GATES.items())}) AS failed_gates FROM m, yy) "
    "SELECT failed_gates, least_available, CASE WHEN failed_gates = '' THEN 'CANDIDATE_ELIGIBLE_FOR_FROZEN_PREREQUISITES' ELSE 'CANDIDATE_REJECTED' END AS decision FROM g",
)
def eligibility_decision(spark, d):
    """Eight gates over aggregated outcomes. Parity: every signal has its outcome once, and longer horizons have no more of them."""
    from barlattice.operators import statistics as stt

    panel = P.kept_bars(spark, d)
    s = P.signals(panel)
    x = P.kept(P.outcomes(panel).join(s.select("symbol", F.col("signal_date").alias("date"), "signal_id"), ["symbol", "date"]).select("signal_id", "date", "ret1", "ret3", "ret5", "ret10"))
    counts = [F.count(f"ret{h}") for h in (1, 3, 5, 10)]
    nested = (counts[3] <= counts[2]) & (counts[2] <= counts[1]) & (counts[1] <= counts[0]) & (F.count_distinct("signal_id") == F.count(F.lit(1)))
    m = x.agg(F.count(F.lit(1)).alias("events"), F.least(*counts).alias("least_available"), F.avg((F.col("ret10") > 0).cast("int")).alias("positive"), F.avg("ret10").alias("mean"), nested.alias("nested"))
    med = stt.exact_quantiles(x, [], "ret10", [0.5]).select(F.col("quantiles")[0].alias("med"))
    y = x.groupBy(F.year("date")).agg(F.count("ret10").alias("n"), F.avg("ret10").alias("mean"))
    yy = y.agg(F.count_if(F.col("n") >= 10).alias("robust"), F.count_if((F.col("n") >= 10) & (F.col("mean") > 0)).alias("good"))
    one = m.crossJoin(med).crossJoin(yy).crossJoin(s.agg(F.count(F.lit(1)).alias("signals"))).withColumn("parity", F.col("nested") & (F.col("events") == F.col("signals")))  # one row each
    failed = F.concat_ws("|", *[F.when(~F.coalesce(F.expr(c), F.lit(False)), n) for n, c in GATES.items()])
    return one.select(failed.alias("failed_gates"), "least_available").withColumn("decision", F.when(F.col("failed_gates") == "", "CANDIDATE_ELIGIBLE_FOR_FROZEN_PREREQUISITES").otherwise("CANDIDATE_REJECTED"))


MARGIN = "CASE WHEN n_failed = 1 THEN CASE failed_conditions WHEN 'PLATFORM_RANGE' THEN round(0.30 - plat_range, 6) WHEN 'CLOSE_ABOVE_PRIOR_HIGH' THEN round(close / prev60_hi_c - 1, 6) WHEN 'VOLUME_EXPANSION' THEN round(vol_ratio_k - 1.8, 6) WHEN 'DAY_CHANGE' THEN round(chg1 - 3, 6) ELSE round(close / ma20 - 1, 6) END END"


@query(
    "o4_14_near_misses",
    f"WITH {B}, {P.INDEX}, {FEATURES}, x AS (SELECT *, {FAILED} AS failed_conditions, CAST({' + '.join(f'CAST(NOT coalesce({c}, FALSE) AS INTEGER)' for c in CONDITIONS.values())} AS INTEGER) AS n_failed FROM fe WHERE rn >= 120) SELECT symbol, date, n_failed, CASE WHEN n_failed = 1 THEN failed_conditions END AS near_miss, {MARGIN} AS margin FROM x",
)
def near_misses(spark, d):
    x = pt.platform_match(features_of(spark, d)).where("rn >= 120").withColumn("n_failed", F.size("failed_conditions"))
    only = F.when(F.col("n_failed") == 1, F.get("failed_conditions", F.lit(0)))
    c = F.col
    margin = F.when(only == "PLATFORM_RANGE", 0.30 - c("plat_range")).when(only == "CLOSE_ABOVE_PRIOR_HIGH", c("close") / c("prev60_hi_c") - 1).when(only == "VOLUME_EXPANSION", c("vol_ratio_k") - 1.8).when(only == "DAY_CHANGE", c("chg1") - 3).when(only == "ABOVE_MA20", c("close") / c("ma20") - 1)
    return x.select("symbol", "date", "n_failed", only.alias("near_miss"), F.round(margin, 6).alias("margin"))


@query("o10_12_level_plan", f"{LEVELS_WITH} SELECT signal_id, round(support, 6) AS support, stop, {rounded('risk target rr')}, trigger, target_type FROM lv")
def level_plan(spark, d):
    return r6(signal_levels(spark, d), "support risk target rr", "signal_id", "stop", "trigger", "target_type")


SCORE = """CAST((CASE WHEN sector_rank <= 10 THEN 10 WHEN sector_rank <= 20 THEN 6 ELSE 2 END) + (CASE WHEN pos250 < 0.35 AND chg10 <= 30 THEN 15 WHEN pos250 < 0.5 THEN 10 WHEN pos250 < 0.65 THEN 5 ELSE 0 END)
+ least((CASE WHEN ud_ratio >= 1.3 THEN 8 WHEN ud_ratio >= 1.1 THEN 5 ELSE 2 END) + (CASE WHEN vol_ratio_k BETWEEN 1.5 AND 4 THEN 4 WHEN vol_ratio_k > 4 THEN 2 ELSE 1 END) + 3, 15) + (CASE WHEN risk <= 0.04 THEN 10 WHEN risk <= 0.06 THEN 6 ELSE 3 END)
+ (CASE WHEN close > ma5 AND ma5 >= ma5_prev THEN 5 WHEN close > ma5 THEN 3 ELSE 0 END) + (CASE WHEN sector_chg >= 1 THEN 10 WHEN sector_chg > 0 THEN 5 ELSE 1 END) + (CASE WHEN rs > 3 THEN 10 WHEN rs > 0 THEN 6 ELSE 2 END) + (CASE WHEN rr >= 3 THEN 10 WHEN rr >= 2.5 THEN 8 ELSE 5 END) AS INTEGER)"""


@query("o10_11_score", f"{LEVELS_WITH} SELECT signal_id, {SCORE} AS score, concat_ws('|', CASE WHEN overhang > 0.35 THEN 'HIGH_OVERHANG' END, CASE WHEN chg20 > 30 THEN 'EXTENDED_20D' END) AS risk_flags FROM lv")
def score(spark, d):
    flags = F.concat_ws("|", F.when(F.col("overhang") > 0.35, "HIGH_OVERHANG"), F.when(F.col("chg20") > 30, "EXTENDED_20D"))
    return signal_levels(spark, d).select("signal_id", pt.score(3).alias("score"), flags.alias("risk_flags"))
