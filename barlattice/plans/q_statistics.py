"""Queries for aggregations (o6), ranks (o7), top-k (o8), sets (o9) and resampling (o11)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlattice.operators import features as fx
from barlattice.operators import patterns as pt
from barlattice.operators import ranks as rk
from barlattice.operators import statistics as stt
from barlattice.sources import panel as P

from .q_execution import AFTER_ENTRY, BASE, COHORT, DELAY, PROSPECTIVE, RULE, first_triggers, horizons_after_entry, kept_path, own_path, prospective, rule_model, trades
from .q_features import COMPRESSION_SQL, PAIR_SQL, PULLBACK_SQL, REGIME_SQL, REVERSAL_SQL, RISK_SQL, pair_series
from .q_patterns import ALL, BOARD, CONDITIONS, LEVELS_WITH, RVC, VCB, features_of, reversal_classified, signal_levels
from .registry import query
from .sql import FEATURES, STEP, W, f

B = P.BARS
OUT = f"{B}, {P.NUMBERED}, {P.OUTCOMES}"


def summary_sql(v: str, mfe: str = "", mae: str = "") -> str:
    out = f"count({v}) AS n, round(avg(CAST({v} > 0 AS INTEGER)), 6) AS positive_rate, round(avg({v}), 6) AS mean, round(avg(CASE WHEN {v} > 0 THEN {v} END), 6) AS mean_gain, round(avg(CASE WHEN {v} < 0 THEN {v} END), 6) AS mean_loss, round(quantile_cont({v}, 0.5), 6) AS median, round(min({v}), 6) AS min, round(max({v}), 6) AS max"
    return out + (f", round(avg({mfe}), 6) AS mean_mfe, round(avg({mae}), 6) AS mean_mae" if mfe else "")


def long_outcomes(panel):
    """Outcomes of every evaluable bar, one row per horizon."""
    x = P.outcomes(panel)
    rows = F.explode(F.array(*[F.struct(F.lit(h).cast("long").alias("horizon"), F.col(f"ret{h}").alias("ret"), F.col(f"mfe{h}").alias("mfe"), F.col(f"mae{h}").alias("mae")) for h in (1, 3, 5, 10)]))
    return x.select("symbol", "date", rows.alias("o")).select("symbol", "date", "o.*")


LONG = "lng AS (" + " UNION ALL ".join(f"SELECT symbol, date, CAST({h} AS BIGINT) AS horizon, ret{h} AS ret, mfe{h} AS mfe, mae{h} AS mae FROM out" for h in (1, 3, 5, 10)) + ")"


@query(
    "o6_1_return_summary",
    f"WITH {OUT}, {LONG}, x AS (SELECT *, CAST(year(date) AS INTEGER) AS y, strftime(date, '%Y-%m') AS m FROM lng) SELECT horizon, y AS period_year, m AS period_month, {summary_sql('ret', 'mfe', 'mae')} FROM x GROUP BY GROUPING SETS ((horizon), (horizon, y), (horizon, m))",
)
def return_summary(spark, d):
    x = long_outcomes(P.bars(spark, d)).withColumn("period_year", F.year("date")).withColumn("period_month", F.date_format("date", "yyyy-MM"))
    # Each row counts in three groups: all of its horizon, its year, its month.
    none = F.struct(F.lit(None).cast("int").alias("period_year"), F.lit(None).cast("string").alias("period_month"))
    year, month = F.struct("period_year", F.lit(None).cast("string").alias("period_month")), F.struct(F.lit(None).cast("int").alias("period_year"), "period_month")
    keys = ["horizon", "period_year", "period_month"]
    x = P.kept(x.select("horizon", "ret", "mfe", "mae", "period_year", "period_month"))
    rows = 3 * x.count()
    x = x.select("horizon", "ret", "mfe", "mae", F.explode(F.array(none, year, month)).alias("g")).select("horizon", "g.*", "ret", "mfe", "mae")
    q = stt.exact_quantiles(x, keys, "ret", [0.5], rows).select(*[F.col(k).alias(f"q_{k}") for k in keys], F.round(F.col("quantiles")[0], 6).alias("median"))
    s = x.groupBy(*keys).agg(*stt.summary("ret", "mfe", "mae", median=False))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"q_{k}"))
    return s.join(q, same, "left").select(*s.columns, "median")


@query(
    "o6_2_frequency_and_concentration",
    f"WITH {BASE}, c AS (SELECT symbol, count(*) AS n FROM sig GROUP BY 1), s AS (SELECT symbol, n, n / sum(n) OVER () AS share, row_number() OVER (ORDER BY n DESC, symbol) AS rk FROM c), t AS (SELECT CAST(sum(n) AS BIGINT) AS signals, count(*) AS symbols, round(sum(share * share), 6) AS hhi, round(sum(share) FILTER (rk <= 1), 6) AS top1, round(sum(share) FILTER (rk <= 5), 6) AS top5 FROM s), "
    "dd AS (SELECT signal_date, count(*) AS n FROM sig GROUP BY 1), e AS (SELECT avg(n) + 3 * stddev_pop(n) AS limit_ FROM dd) SELECT t.*, count(*) AS active_dates, count(*) FILTER (dd.n > limit_) AS anomalous_dates FROM t, dd, e GROUP BY ALL",
)
def frequency_and_concentration(spark, d):
    s = P.signals(P.bars(spark, d))
    c = s.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    c = c.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total"))  # one row
    best = c.orderBy(F.col("n").desc(), "symbol").limit(5).withColumn("rk", F.row_number().over(Window.orderBy(F.col("n").desc(), "symbol")))
    top = best.agg(F.round(F.sum(F.when(F.col("rk") == 1, F.col("share"))), 6).alias("top1"), F.round(F.sum("share"), 6).alias("top5"))
    t = c.agg(F.sum("n").alias("signals"), F.count(F.lit(1)).alias("symbols"), F.round(F.sum(F.col("share") * F.col("share")), 6).alias("hhi"))
    daily = s.groupBy("signal_date").agg(F.count(F.lit(1)).alias("n"))
    limit = daily.agg((F.avg("n") + 3 * F.stddev_pop("n")).alias("limit"))
    dates = daily.crossJoin(F.broadcast(limit)).agg(F.count(F.lit(1)).alias("active_dates"), F.count_if(F.col("n") > F.col("limit")).alias("anomalous_dates"))
    return t.crossJoin(top).crossJoin(dates).select(  # one row each
        "signals", "symbols", "hhi", "top1", "top5", "active_dates", "anomalous_dates")


FREQUENCY = {"DAY": ("CAST(signal_date AS VARCHAR)", "CAST(signal_date AS STRING)"), "MONTH": ("strftime(signal_date, '%Y-%m')", "date_format(signal_date, 'yyyy-MM')"), "YEAR": ("CAST(year(signal_date) AS VARCHAR)", "CAST(year(signal_date) AS STRING)"), "PHASE": ("CASE WHEN signal_date < DATE '1998-01-01' THEN 'EARLY' ELSE 'LATE' END",) * 2}


@query("o6_2b_signal_frequency", f"WITH {BASE} " + " UNION ALL ".join(f"SELECT '{level}' AS level, {sql} AS period, count(*) AS n, count(DISTINCT symbol) AS symbols, count(DISTINCT signal_date) AS dates FROM sig GROUP BY 2" for level, (sql, _) in FREQUENCY.items()))
def signal_frequency(spark, d):
    s = P.signals(P.bars(spark, d)).select("symbol", "signal_date")
    each = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.expr(e).alias("period")) for level, (_, e) in FREQUENCY.items()]))
    return s.select("symbol", "signal_date", each.alias("g")).groupBy("g.level", "g.period").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("symbols"), F.count_distinct("signal_date").alias("dates"))


@query("o6_2c_top_symbols", f"WITH {BASE}, c AS (SELECT symbol, count(*) AS n FROM sig GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY n DESC, symbol) AS BIGINT) AS rank, symbol, n, round(n / (SELECT sum(n) FROM c), 6) AS share FROM c ORDER BY n DESC, symbol LIMIT 10")
def top_symbols(spark, d):
    c = P.signals(P.bars(spark, d)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    best = c.orderBy(F.col("n").desc(), "symbol").limit(10).crossJoin(F.broadcast(c.agg(F.sum("n").alias("total"))))
    return best.select(F.row_number().over(Window.orderBy(F.col("n").desc(), "symbol")).cast("long").alias("rank"), "symbol", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("o6_3_daily_funnel", f"WITH {B}, {P.INDEX}, {FEATURES} SELECT date, count(*) AS evaluated, {', '.join(f'count(*) FILTER ({c}) AS n_{n.lower()}' for n, c in CONDITIONS.items())}, count(*) FILTER ({ALL}) AS matched, CASE WHEN date < DATE '1998-01-01' THEN 'EARLY' ELSE 'LATE' END AS phase FROM fe WHERE rn >= 120 GROUP BY date")
def daily_funnel(spark, d):
    x = features_of(spark, d).where("rn >= 120")
    conditions = pt.platform_conditions()
    met = F.lit(True)
    for c in conditions.values():
        met = met & F.coalesce(c, F.lit(False))
    g = x.groupBy("date").agg(F.count(F.lit(1)).alias("evaluated"), *[F.count_if(c).alias(f"n_{n.lower()}") for n, c in conditions.items()], F.count_if(met).alias("matched"))
    return g.withColumn("phase", F.when(F.col("date") < F.lit("1998-01-01").cast("date"), "EARLY").otherwise("LATE"))


@query(
    "o6_4_distribution",
    f"WITH {OUT}, {LONG} SELECT horizon, count(ret) AS n, {', '.join(f'round(quantile_cont(ret, {p / 100}), 6) AS p{p}' for p in (10, 25, 50, 75, 90))}, round(stddev_pop(ret), 6) AS std FROM lng GROUP BY 1",
)
def distribution(spark, d):
    x = P.kept(long_outcomes(P.bars(spark, d)).select("horizon", "ret"))
    q = stt.exact_quantiles(x, ["horizon"], "ret", [0.1, 0.25, 0.5, 0.75, 0.9])
    s = x.groupBy("horizon").agg(F.count("ret").alias("n"), F.round(F.stddev_pop("ret"), 6).alias("std")).join(q, "horizon", "left")
    return s.select("horizon", "n", *[F.round(F.col("quantiles")[i], 6).alias(f"p{p}") for i, p in enumerate((10, 25, 50, 75, 90))], "std")


TRADES = """SELECT count(*) AS signals, count(return_pct) AS closed, count(*) FILTER (status = 'NOT_TRIGGERED') AS not_triggered, count(*) FILTER (status = 'UNVERIFIED') AS unverified, count(*) FILTER (status = 'EXIT_AMBIGUOUS') AS ambiguous, round(avg(CAST(return_pct > 0 AS INTEGER)), 6) AS win_rate_by_return,
round(count(*) FILTER (status LIKE 'EXIT_TARGET%') / nullif(count(return_pct), 0), 6) AS win_rate_by_target, round(avg(return_pct), 6) AS expectancy, round(avg(return_pct) FILTER (return_pct > 0) / nullif(-avg(return_pct) FILTER (return_pct < 0), 0), 6) AS payoff, round(sum(return_pct) FILTER (return_pct > 0) / nullif(-sum(return_pct) FILTER (return_pct < 0), 0), 6) AS profit_factor, round(avg(exit_step - entry_step), 6) AS mean_holding"""


def trade_stats() -> list:
    r, s = F.col("return_pct"), F.col("status")
    gain, loss = F.when(r > 0, r), F.when(r < 0, r)
    return [
        F.count(F.lit(1)).alias("signals"), F.count("return_pct").alias("closed"), F.count_if(s == "NOT_TRIGGERED").alias("not_triggered"), F.count_if(s == "UNVERIFIED").alias("unverified"), F.count_if(s == "EXIT_AMBIGUOUS").alias("ambiguous"),
        F.round(stt.rate(r > 0), 6).alias("win_rate_by_return"), F.round(F.try_divide(F.count_if(s.startswith("EXIT_TARGET")), F.count("return_pct")), 6).alias("win_rate_by_target"), F.round(F.avg("return_pct"), 6).alias("expectancy"),
        F.round(F.try_divide(F.avg(gain), -F.avg(loss)), 6).alias("payoff"), F.round(F.try_divide(F.sum(gain), -F.sum(loss)), 6).alias("profit_factor"), F.round(F.avg(F.col("exit_step") - F.col("entry_step")), 6).alias("mean_holding"),
    ]


@query("o6_5_trade_performance", f"WITH {PROSPECTIVE} {TRADES} FROM rp")
def trade_performance(spark, d):
    return prospective(spark, d).agg(*trade_stats())


@query("o6_5b_rule_performance", f"WITH {RULE} {TRADES} FROM rp")
def rule_performance(spark, d):
    return rule_model(spark, d).agg(*trade_stats())


TRADE_DETAIL = f"""{PROSPECTIVE}, td AS (SELECT rp.*, sig.trigger, sig.stop, CASE WHEN exit_price IS NOT NULL AND entry_price > sig.stop THEN (exit_price - entry_price) / (entry_price - sig.stop) END AS r FROM rp JOIN sig USING (signal_id)),
tx AS (SELECT td.signal_id, max((b_high / entry_price - 1) * 100) AS hi, min((b_low / entry_price - 1) * 100) AS lo FROM td JOIN pth ON pth.signal_id = td.signal_id AND step BETWEEN entry_step AND exit_step GROUP BY 1),
tm AS (SELECT td.signal_id, max(step) FILTER (b_close IS NOT NULL) AS seen, arg_max(b_close, step) FILTER (b_close IS NOT NULL) AS mark FROM td JOIN pth ON pth.signal_id = td.signal_id AND step >= entry_step AND td.status = 'UNVERIFIED' GROUP BY 1),
tr AS (SELECT td.*, greatest(0, hi) AS mfe, least(0, lo) AS mae, (mark / entry_price - 1) * 100 AS mtm FROM td LEFT JOIN tx USING (signal_id) LEFT JOIN tm USING (signal_id))"""
CLOSED = "return_pct IS NOT NULL AND status <> 'EXIT_AMBIGUOUS'"


@query(
    "o6_5c_trade_details",
    f"WITH {TRADE_DETAIL} SELECT count(*) FILTER ({CLOSED}) AS closed, round(avg(r) FILTER ({CLOSED}), 6) AS avg_r, round(median(r) FILTER ({CLOSED}), 6) AS median_r, round(median(return_pct) FILTER ({CLOSED}), 9) AS median_return, "
    + ", ".join(f"count(*) FILTER ({CLOSED} AND status LIKE 'EXIT_{k}%') AS {k.lower()}_exits, round(count(*) FILTER ({CLOSED} AND status LIKE 'EXIT_{k}%') / nullif(count(*) FILTER ({CLOSED}), 0) * 100, 6) AS {k.lower()}_rate" for k in ("TARGET", "STOP", "TIME"))
    + f", round(median(exit_step - entry_step) FILTER ({CLOSED}), 6) AS median_holding, round(avg(mfe) FILTER ({CLOSED}), 6) AS avg_mfe, round(avg(mae) FILTER ({CLOSED}), 6) AS avg_mae, round(median(mfe) FILTER ({CLOSED}), 6) AS median_mfe, round(median(mae) FILTER ({CLOSED}), 6) AS median_mae, count(mtm) AS open_positions, round(avg(mtm), 6) AS open_mtm, count(*) FILTER ({CLOSED}) < 10 AS sample_small FROM tr",
)
def trade_details(spark, d):
    """R multiples, exits, holding, excursions and marks of open positions under the prospective model."""
    t = P.kept(trades(spark, d))
    closed = t.where(F.col("return_pct").isNotNull() & (F.col("status") != "EXIT_AMBIGUOUS"))
    n = F.count(F.lit(1))
    exits = [x for k in ("TARGET", "STOP", "TIME") for x in (F.count_if(F.col("status").startswith(f"EXIT_{k}")).alias(f"{k.lower()}_exits"), F.round(F.try_divide(F.count_if(F.col("status").startswith(f"EXIT_{k}")), n) * 100, 6).alias(f"{k.lower()}_rate"))]
    a = closed.agg(n.alias("closed"), F.round(F.avg("r"), 6).alias("avg_r"), *exits, F.round(F.avg("mfe"), 6).alias("avg_mfe"), F.round(F.avg("mae"), 6).alias("avg_mae"), (n < 10).alias("sample_small"))
    o = t.agg(F.count("mtm").alias("open_positions"), F.round(F.avg("mtm"), 6).alias("open_mtm"))
    measures = {"r": "median_r", "return_pct": "median_return", "holding": "median_holding", "mfe": "median_mfe", "mae": "median_mae"}
    stacked = closed.select(F.explode(F.array(*[F.struct(F.lit(out).alias("measure"), F.col(c).cast("double").alias("v")) for c, out in measures.items()])).alias("m")).select("m.*")
    q = stt.exact_quantiles(stacked, ["measure"], "v", [0.5])
    q = q.agg(*[F.round(F.max(F.when(F.col("measure") == out, F.col("quantiles")[0])), 9 if out == "median_return" else 6).alias(out) for out in measures.values()])
    return a.crossJoin(o).crossJoin(q)  # one row each


@query(
    "o6_5d_excluded_signals",
    f"WITH {PROSPECTIVE} SELECT CASE WHEN status = 'UNVERIFIED' AND entry_step IS NOT NULL THEN 'OPEN_UNVERIFIED' WHEN status = 'UNVERIFIED' THEN 'UNVERIFIED_MISSING_OBSERVATION' WHEN status = 'NOT_TRIGGERED' THEN 'EXPIRED_UNTRIGGERED' WHEN status = 'EXIT_AMBIGUOUS' THEN 'AMBIGUOUS_SAME_BAR' ELSE 'NOT_A_CONFIRMED_CLOSED_TRADE' END AS reason, count(*) AS n FROM rp WHERE return_pct IS NULL OR status = 'EXIT_AMBIGUOUS' GROUP BY 1",
)
def excluded_signals(spark, d):
    s, out = F.col("status"), prospective(spark, d).where("return_pct IS NULL OR status = 'EXIT_AMBIGUOUS'")
    reason = F.when((s == "UNVERIFIED") & F.col("entry_step").isNotNull(), "OPEN_UNVERIFIED").when(s == "UNVERIFIED", "UNVERIFIED_MISSING_OBSERVATION").when(s == "NOT_TRIGGERED", "EXPIRED_UNTRIGGERED").when(s == "EXIT_AMBIGUOUS", "AMBIGUOUS_SAME_BAR").otherwise("NOT_A_CONFIRMED_CLOSED_TRADE")
    return out.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "o6_6_performance_by_regime",
    f"WITH {PROSPECTIVE}, {P.INDEX}, {REGIME_SQL}, xr AS (SELECT rp.*, trend, volatility FROM rp JOIN sig USING (signal_id) JOIN rg ON rg.date = sig.signal_date) SELECT trend, volatility, count(return_pct) AS closed, round(avg(return_pct), 6) AS mean, round(avg(CAST(status LIKE 'EXIT_STOP%' AND exit_step - entry_step <= 2 AS INTEGER)), 6) AS fast_stop_rate FROM xr GROUP BY GROUPING SETS ((), (trend), (volatility))",
)
def performance_by_regime(spark, d):
    panel = P.bars(spark, d)
    r = fx.regime(P.index_bars(panel)).select(F.col("date").alias("signal_date"), "trend", "volatility")
    x = prospective(spark, d).join(P.signals(panel).select("signal_id", "signal_date"), "signal_id").join(F.broadcast(r), "signal_date")
    fast = F.coalesce(F.col("status").startswith("EXIT_STOP") & (F.col("exit_step") - F.col("entry_step") <= 2), F.lit(False))
    return x.groupingSets([[], ["trend"], ["volatility"]], "trend", "volatility").agg(F.count("return_pct").alias("closed"), F.round(F.avg("return_pct"), 6).alias("mean"), F.round(F.avg(fast.cast("int")), 6).alias("fast_stop_rate"))


@query(
    "o6_7_delay_cohorts",
    f"WITH {AFTER_ENTRY}, {DELAY}, cx AS (SELECT cl.delay, ae.* FROM cl JOIN ae ON ae.signal_id = cl.signal_id AND ae.k = 5 WHERE cl.delay IS NOT NULL), xx AS (SELECT delay, CASE WHEN status IN ('TERMINAL', 'MARKED') THEN round((price / entry_price - 1) * 100, 6) END AS r FROM cx) SELECT k.c AS cutoff, count(*) FILTER (delay <= k.c) AS early_n, round(avg(r) FILTER (delay <= k.c), 6) AS early_mean, round(avg(r) FILTER (delay > k.c), 6) AS late_mean FROM xx CROSS JOIN (VALUES (1::BIGINT), (2), (3), (5), (10)) k(c) GROUP BY 1",
)
def delay_cohorts(spark, d):
    x = first_triggers(spark, d).where("delay IS NOT NULL").select("signal_id", "delay").join(horizons_after_entry(spark, d).where("horizon = 5").select("signal_id", F.col("return_pct").alias("r")), "signal_id")
    x = x.withColumn("cutoff", F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3, 5, 10)])))
    early = F.col("delay") <= F.col("cutoff")
    return x.groupBy("cutoff").agg(F.count_if(early).alias("early_n"), F.round(F.avg(F.when(early, F.col("r"))), 6).alias("early_mean"), F.round(F.avg(F.when(~early, F.col("r"))), 6).alias("late_mean"))


TEN = DELAY.replace("FROM pth", "FROM pth WHERE step <= 10")  # the path has an eleventh step, for late exits
COHORTS = f"{AFTER_ENTRY}, {TEN}, co AS (SELECT cl.*, {COHORT} AS cohort, rp.status AS outcome, rp.return_pct, rp.exit_step - rp.entry_step AS holding FROM cl JOIN rp USING (signal_id)), e5 AS (SELECT signal_id, CASE WHEN ae.status IN ('TERMINAL', 'MARKED') THEN (price / entry_price - 1) * 100 END AS e5 FROM ae WHERE k = 5)"
COHORT_METRICS = """count(*) AS signals, count(return_pct) FILTER (outcome <> 'EXIT_AMBIGUOUS') AS resolved, count(*) FILTER (outcome = 'EXIT_AMBIGUOUS') AS ambiguous, count(*) FILTER (outcome LIKE 'EXIT_TARGET%') AS targets, count(*) FILTER (outcome LIKE 'EXIT_STOP%') AS stops, count(*) FILTER (outcome = 'EXIT_TIME') AS timed,
round(count(*) FILTER (outcome LIKE 'EXIT_TARGET%') / nullif(count(return_pct) FILTER (outcome <> 'EXIT_AMBIGUOUS'), 0) * 100, 6) AS win_rate, round(avg(return_pct), 9) AS mean_return, round(avg(return_pct) FILTER (return_pct > 0) / nullif(-avg(return_pct) FILTER (return_pct < 0), 0), 9) AS payoff, round(avg(holding) FILTER (return_pct IS NOT NULL), 6) AS mean_holding, round(avg(e5), 6) AS mean_e5"""


def cohort_rows(spark, d):
    """Every signal with its delay, cohort, outcome and the mark five bars after entry."""
    path = kept_path(spark, d, 11)
    r = prospective(spark, d, path).select("signal_id", F.col("status").alias("outcome"), "return_pct", (F.col("exit_step") - F.col("entry_step")).alias("holding"))
    e = horizons_after_entry(spark, d, rounded=False, path=path).where("horizon = 5").select("signal_id", F.col("return_pct").alias("e5"))
    return first_triggers(spark, d, path.where("step <= 10")).join(r, "signal_id").join(e, "signal_id", "left")


def cohort_metrics() -> list:
    r, o = F.col("return_pct"), F.col("outcome")
    resolved = F.count(F.when(o != "EXIT_AMBIGUOUS", r))
    target = F.count_if(o.startswith("EXIT_TARGET"))
    return [
        F.count(F.lit(1)).alias("signals"), resolved.alias("resolved"), F.count_if(o == "EXIT_AMBIGUOUS").alias("ambiguous"), target.alias("targets"), F.count_if(o.startswith("EXIT_STOP")).alias("stops"), F.count_if(o == "EXIT_TIME").alias("timed"),
        F.round(F.try_divide(target, resolved) * 100, 6).alias("win_rate"), F.round(F.avg(r), 9).alias("mean_return"), F.round(F.try_divide(F.avg(F.when(r > 0, r)), -F.avg(F.when(r < 0, r))), 9).alias("payoff"), F.round(F.avg(F.when(r.isNotNull(), F.col("holding"))), 6).alias("mean_holding"), F.round(F.avg("e5"), 6).alias("mean_e5"),
    ]


@query("o6_7b_cohort_metrics", f"WITH {COHORTS} SELECT coalesce(cohort, co.status) AS cohort, {COHORT_METRICS} FROM co LEFT JOIN e5 USING (signal_id) GROUP BY 1")
def cohort_summary(spark, d):
    return cohort_rows(spark, d).groupBy(F.coalesce("cohort", "status").alias("cohort")).agg(*cohort_metrics())


@query("o6_7c_by_delay", f"WITH {COHORTS} SELECT delay, {COHORT_METRICS} FROM co LEFT JOIN e5 USING (signal_id) WHERE delay IS NOT NULL GROUP BY 1")
def by_delay(spark, d):
    return cohort_rows(spark, d).where("delay IS NOT NULL").groupBy("delay").agg(*cohort_metrics())


@query(
    "o6_8_daily_equal_weight",
    f"WITH {OUT}, {LONG}, a AS (SELECT horizon, {BOARD} AS board, date, avg(ret) AS m FROM lng WHERE ret IS NOT NULL GROUP BY 1, 2, 3) SELECT horizon, board, count(*) AS n_dates, round(avg(m), 6) AS daily_mean FROM a GROUP BY 1, 2",
)
def daily_equal_weight(spark, d):
    x = long_outcomes(P.bars(spark, d)).where("ret IS NOT NULL").withColumn("board", pt.board(F.col("symbol")))
    return stt.daily_equal(x, "date", "ret", ["horizon", "board"])


RV_OUT = f"{OUT}, {REVERSAL_SQL}, {RVC}, rcl AS (SELECT symbol, date, t_day_return, CASE WHEN NOT downside THEN 'OUTSIDE' WHEN bounce AND reclaim THEN 'CANDIDATE' WHEN bounce THEN 'PRIMARY_CONTROL' ELSE 'BASELINE' END AS class FROM rvc), rbn AS (SELECT *, CAST(least(5, ((row_number() OVER (PARTITION BY date ORDER BY t_day_return, symbol) - 1) * 5) // count(*) OVER (PARTITION BY date) + 1) AS INTEGER) AS bin FROM rcl), ro AS (SELECT rbn.*, ret10 FROM rbn JOIN out ON out.symbol = rbn.symbol AND out.date = rbn.date WHERE ret10 IS NOT NULL)"


def reversal_outcomes(panel):
    x = reversal_classified(panel)
    x = x.withColumn("bin", rk.equal_bins(["date"], ["t_day_return", "symbol"], 5))
    return x.select("symbol", "date", "class", "bin", "t_day_return").join(P.outcomes(panel).select("symbol", "date", "ret10"), ["symbol", "date"]).where("ret10 IS NOT NULL")


@query(
    "o6_9_stratified_spread",
    f"WITH {RV_OUT}, g AS (SELECT date, bin, avg(ret10) FILTER (class = 'CANDIDATE') AS l, avg(ret10) FILTER (class = 'PRIMARY_CONTROL') AS r FROM ro GROUP BY 1, 2), s AS (SELECT date, count(*) AS shared_bins, avg(l - r) AS spread FROM g WHERE l IS NOT NULL AND r IS NOT NULL GROUP BY 1) SELECT date, shared_bins, round(spread, 6) AS spread FROM s",
)
def stratified_spread(spark, d):
    x = reversal_outcomes(P.bars(spark, d))
    g = x.groupBy("date", "bin").agg(F.avg(F.when(F.col("class") == "CANDIDATE", F.col("ret10"))).alias("l"), F.avg(F.when(F.col("class") == "PRIMARY_CONTROL", F.col("ret10"))).alias("r"))
    return g.where("l IS NOT NULL AND r IS NOT NULL").groupBy("date").agg(F.count(F.lit(1)).alias("shared_bins"), F.round(F.avg(F.col("l") - F.col("r")), 6).alias("spread"))


@query(
    "o6_10_daily_group_means",
    f"WITH {OUT}, {COMPRESSION_SQL}, {VCB}, cl AS (SELECT symbol, date, ratio, CASE WHEN NOT is_breakout THEN 'NONE' WHEN ratio < 1 AND rk <= ceil(0.2 * n) THEN 'CANDIDATE' ELSE 'CONTROL' END AS class FROM vc) SELECT cl.date, count(ret10) AS n, round(avg(ret10), 6) AS baseline, round(avg(ret10) FILTER (class = 'CANDIDATE'), 6) AS candidate, round(avg(ret10) FILTER (class = 'CONTROL'), 6) AS control FROM cl JOIN out ON out.symbol = cl.symbol AND out.date = cl.date GROUP BY 1",
)
def daily_group_means(spark, d):
    from .q_patterns import compression_breakout

    x = compression_breakout(spark, d).join(P.outcomes(P.bars(spark, d)).select("symbol", "date", "ret10"), ["symbol", "date"])

    def mean(c):
        return F.round(F.avg(F.when(F.col("class") == c, F.col("ret10"))), 6)

    return x.groupBy("date").agg(F.count("ret10").alias("n"), F.round(F.avg("ret10"), 6).alias("baseline"), mean("CANDIDATE").alias("candidate"), mean("CONTROL").alias("control"))


BINS = f"{OUT}, fb AS (SELECT o.symbol, o.date, ret10, volume / avg(volume) {f(-20, -1)} AS rv, turnover FROM out o), fq AS (SELECT *, CAST(least(5, floor((row_number() OVER (ORDER BY rv, symbol, date) - 1) * 5.0 / count(*) OVER ()) + 1) AS INTEGER) AS q1, CAST(least(5, floor((row_number() OVER (ORDER BY turnover, symbol, date) - 1) * 5.0 / count(*) OVER ()) + 1) AS INTEGER) AS q2 FROM fb WHERE rv IS NOT NULL AND ret10 IS NOT NULL)"


def global_bins(df, feature: str, name: str, bins: int = 5):
    """Equal-count bins over the whole table, ties by symbol and date."""
    x = stt.places(df, [feature, "symbol", "date"], "__place")
    return x.withColumn(name, F.least(F.lit(bins), F.floor(F.col("__place") * bins / F.col("__all")) + 1).cast("int")).drop("__place", "__all")


def bin_inputs(spark, d):
    """Relative volume, turnover and outcome of every evaluable bar, kept as several passes follow."""
    x = P.outcomes(P.bars(spark, d)).withColumn("rv", F.col("volume") / F.avg("volume").over(fx.back(-20, -1)))
    return P.kept(x.where("rv IS NOT NULL AND ret10 IS NOT NULL").select("symbol", "date", "rv", "turnover", "ret10"))


def feature_bins(spark, d):
    return global_bins(global_bins(bin_inputs(spark, d), "rv", "q1"), "turnover", "q2")


@query(
    "o6_11_quintile_matrix",
    f"WITH {BINS}, g AS (SELECT CAST(a AS INTEGER) AS q1, CAST(b AS INTEGER) AS q2 FROM range(1, 6) t(a), range(1, 6) u(b)) SELECT g.q1, g.q2, count(ret10) AS n, round(avg(ret10), 6) AS mean FROM g LEFT JOIN fq ON fq.q1 = g.q1 AND fq.q2 = g.q2 GROUP BY 1, 2",
)
def quintile_matrix(spark, d):
    grid = spark.range(25).select((F.floor(F.col("id") / 5) + 1).cast("int").alias("q1"), (F.col("id") % 5 + 1).cast("int").alias("q2"))
    cells = feature_bins(spark, d).groupBy("q1", "q2").agg(F.count("ret10").alias("n"), F.round(F.avg("ret10"), 6).alias("mean"))
    return grid.join(cells, ["q1", "q2"], "left").select("q1", "q2", F.coalesce("n", F.lit(0)).alias("n"), "mean")


@query(
    "o6_12_strata_spread",
    f"WITH {BINS}, x AS (SELECT year(date) AS y, {BOARD} AS board, q1, ret10 FROM fq), s AS (SELECT y, board, count(*) AS n, avg(ret10) FILTER (q1 = 5) - avg(ret10) FILTER (q1 = 1) AS spread FROM x GROUP BY 1, 2) SELECT board, count(*) FILTER (n >= 30) AS strata, count(*) FILTER (n >= 30 AND spread > 0) AS positive, count(*) FILTER (n >= 30 AND spread < 0) AS negative FROM s GROUP BY 1",
)
def strata_spread(spark, d):
    x = feature_bins(spark, d).groupBy(F.year("date").alias("y"), pt.board(F.col("symbol")).alias("board")).agg(F.count(F.lit(1)).alias("n"), (F.avg(F.when(F.col("q1") == 5, F.col("ret10"))) - F.avg(F.when(F.col("q1") == 1, F.col("ret10")))).alias("spread"))
    big = F.col("n") >= 30
    return x.groupBy("board").agg(F.count_if(big).alias("strata"), F.count_if(big & (F.col("spread") > 0)).alias("positive"), F.count_if(big & (F.col("spread") < 0)).alias("negative"))


@query("o6_13_monthly_concentration", f"WITH {BASE} SELECT strftime(signal_date, '%Y-%m') AS month, count(*) AS n, count(DISTINCT symbol) AS symbols, count(DISTINCT signal_date) AS dates FROM sig GROUP BY 1")
def monthly_concentration(spark, d):
    return P.signals(P.bars(spark, d)).groupBy(F.date_format("signal_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("symbols"), F.count_distinct("signal_date").alias("dates"))


EDGES = [-10.0, -5.0, -2.0, 0.0, 2.0, 5.0, 10.0]


def bucket_name(value, sql: bool = False):
    return f"CASE WHEN {value} IS NULL THEN 'UNAVAILABLE' " + " ".join(f"WHEN {value} < {e} THEN 'LT_{e:g}'" for e in EDGES) + f" ELSE 'GE_{EDGES[-1]:g}' END"


@query(
    "o6_14_histogram",
    f"WITH {OUT}, {LONG}, b AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}LT_{e:g}{chr(39)})' for e in EDGES)}, ('GE_10'), ('UNAVAILABLE')) t(bucket)), h AS (SELECT DISTINCT horizon FROM lng), c AS (SELECT horizon, {bucket_name('ret')} AS bucket, count(*) AS n FROM lng GROUP BY 1, 2) SELECT h.horizon, b.bucket, coalesce(n, 0) AS n FROM h CROSS JOIN b LEFT JOIN c ON c.horizon = h.horizon AND c.bucket = b.bucket",
)
def histogram(spark, d):
    x = long_outcomes(P.bars(spark, d)).groupBy("horizon", F.expr(bucket_name("ret")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    names = [f"LT_{e:g}" for e in EDGES] + ["GE_10", "UNAVAILABLE"]
    grid = spark.createDataFrame([(h, b) for h in (1, 3, 5, 10) for b in names], "horizon long, bucket string")
    return grid.join(x, ["horizon", "bucket"], "left").select("horizon", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "o6_15_turnover_semantics",
    f"WITH {B}, x AS (SELECT symbol, date, turnover / (volume * 200) AS implied, close AS reported FROM bars), y AS (SELECT date, count(*) AS n, count(*) FILTER (abs(implied - reported) <= greatest(0.05, 0.02 * abs(reported))) AS matched, quantile_cont(implied / reported, 0.5) AS ratio FROM x GROUP BY 1) "
    "SELECT date, n, matched, round(ratio, 6) AS median_ratio, (matched / n >= 0.95) AS semantics_ok, CASE WHEN ratio BETWEEN 8 AND 12 THEN 'SCALE_10' WHEN ratio BETWEEN 80 AND 120 THEN 'SCALE_100' ELSE 'NONE' END AS scale_error FROM y",
)
def turnover_semantics(spark, d):
    x = P.bars(spark, d).select("date", (F.col("turnover") / (F.col("volume") * 200)).alias("implied"), F.col("close").alias("reported"))
    ok = F.abs(F.col("implied") - F.col("reported")) <= F.greatest(F.lit(0.05), 0.02 * F.abs("reported"))
    y = x.withColumn("q", F.col("implied") / F.col("reported")).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("matched"), F.expr("percentile(q, 0.5)").alias("ratio"))
    return y.select("date", "n", "matched", F.round("ratio", 6).alias("median_ratio"), (F.col("matched") / F.col("n") >= 0.95).alias("semantics_ok"), F.when(F.col("ratio").between(8, 12), "SCALE_10").when(F.col("ratio").between(80, 120), "SCALE_100").otherwise("NONE").alias("scale_error"))


@query(
    "o6_16_match_counts",
    f"WITH {OUT}, r AS (SELECT date, count(*) FILTER (close > prev) AS up, count(*) AS n FROM (SELECT symbol, date, close, lag(close) {W} AS prev FROM bars) GROUP BY 1), s AS (SELECT date, count(*) AS evaluated, count(ret10) AS known FROM out GROUP BY 1) SELECT r.date, up AS rising, coalesce(evaluated, 0) AS evaluated, CASE WHEN evaluated IS NULL THEN 'PENDING' WHEN up = 0 THEN 'NONE' ELSE 'MATCH' END AS status FROM r LEFT JOIN s USING (date)",
)
def match_counts(spark, d):
    panel = P.bars(spark, d)
    r = panel.withColumn("prev", F.lag("close").over(fx.by_symbol())).groupBy("date").agg(F.count_if(F.col("close") > F.col("prev")).alias("rising"))
    s = P.numbered(panel).where("rn >= 120").groupBy("date").agg(F.count(F.lit(1)).alias("e"))
    return r.join(s, "date", "left").select("date", "rising", F.coalesce("e", F.lit(0)).alias("evaluated"), F.when(F.col("e").isNull(), "PENDING").when(F.col("rising") == 0, "NONE").otherwise("MATCH").alias("status"))


@query(
    "o6_17_model_categories",
    f"WITH p AS (WITH {PROSPECTIVE} SELECT * FROM rp), r AS (WITH {RULE} SELECT * FROM rp), j AS (SELECT coalesce(p.signal_id, r.signal_id) AS signal_id, CASE WHEN p.status = r.status THEN 'SAME_STATUS' WHEN p.entry_step IS DISTINCT FROM r.entry_step THEN 'DIFFERENT_ENTRY' ELSE 'DIFFERENT_EXIT' END AS category, p.return_pct AS a, r.return_pct AS b FROM p FULL JOIN r ON p.signal_id = r.signal_id) "
    "SELECT category, count(*) AS n, count(a) AS n_prospective, count(b) AS n_rule, round(avg(a), 6) AS mean_prospective, round(avg(b), 6) AS mean_rule FROM j GROUP BY 1",
)
def model_categories(spark, d):
    from .q_joins import model_pairs

    return model_pairs(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count("prospective_return").alias("n_prospective"), F.count("rule_return").alias("n_rule"), F.round(F.avg("prospective_return"), 6).alias("mean_prospective"), F.round(F.avg("rule_return"), 6).alias("mean_rule"))


@query(
    "o6_18_style_conclusion",
    f"WITH {B}, {PAIR_SQL}, sc AS (SELECT n_name AS sector, date, avg(close) AS close FROM bars JOIN supplier ON {P.SYMBOL.format('s_suppkey')} = symbol JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2), sc2 AS (SELECT sector, date, (close / lag(close, 20) OVER (PARTITION BY sector ORDER BY date) - 1) * 100 AS chg FROM sc) "
    "SELECT p.date, CASE WHEN chg20 > 2 THEN 'FIRST_LEADS' WHEN chg20 < -2 THEN 'SECOND_LEADS' WHEN chg20 IS NOT NULL THEN 'BALANCED' END AS style, arg_max(sector, (chg, sector)) AS strongest, arg_min(sector, (chg, sector)) AS weakest FROM pair p LEFT JOIN sc2 ON sc2.date = p.date AND sc2.chg IS NOT NULL GROUP BY p.date, chg20",
)
def style_conclusion(spark, d):
    panel = P.bars(spark, d)
    w = Window.partitionBy("sector").orderBy("date")
    sc = panel.join(P.sectors(spark, d), "symbol").groupBy("sector", "date").agg(F.avg("close").alias("close")).withColumn("chg", fx.pct(F.col("close"), F.lag("close", 20).over(w))).where("chg IS NOT NULL")
    best = sc.groupBy("date").agg(F.max_by("sector", F.struct("chg", "sector")).alias("strongest"), F.min_by("sector", F.struct("chg", "sector")).alias("weakest"))
    style = F.when(F.col("chg20") > 2, "FIRST_LEADS").when(F.col("chg20") < -2, "SECOND_LEADS").when(F.col("chg20").isNotNull(), "BALANCED")
    return pair_series(panel).select("date", style.alias("style")).join(best, "date", "left")


# Ranks --------------------------------------------------------------------------------------------


def risk(spark, d):
    return fx.returns_and_risk(P.bars(spark, d)).where("r60 IS NOT NULL")


RS = f"{B}, {RISK_SQL}, rs AS (SELECT * FROM rk WHERE r60 IS NOT NULL)"


@query("o7_1_top_quintile", f"WITH {RS}, x AS (SELECT symbol, date, row_number() OVER (PARTITION BY date ORDER BY r60 DESC, symbol) AS rank, count(*) OVER (PARTITION BY date) AS n FROM rs) SELECT symbol, date, rank, n, rank <= ceil(0.2 * n) AS selected FROM x")
def top_quintile(spark, d):
    return rk.top_fraction(risk(spark, d), ["date"], "r60", "symbol").select("symbol", "date", "rank", "n", "selected")


@query("o7_2_bottom_quintile", f"WITH {RS}, x AS (SELECT symbol, date, row_number() OVER (PARTITION BY date ORDER BY vol20, symbol) AS rank, count(*) OVER (PARTITION BY date) AS n FROM rs) SELECT symbol, date, rank, n, rank <= ceil(0.2 * n) AS selected FROM x")
def bottom_quintile(spark, d):
    return rk.top_fraction(risk(spark, d), ["date"], "vol20", "symbol", ascending=True).select("symbol", "date", "rank", "n", "selected")


@query("o7_3_average_rank", f"WITH {RS} SELECT symbol, date, rank() OVER (PARTITION BY date ORDER BY round(r20, 2)) + (count(*) OVER (PARTITION BY date, round(r20, 2)) - 1) / 2.0::DOUBLE AS average_rank FROM rs")
def average_rank(spark, d):
    x = risk(spark, d).withColumn("v", F.round("r20", 2))
    return x.select("symbol", "date", rk.average_rank(["date"], "v").alias("average_rank"))


IC = f"{RS}, {P.OUTCOMES}, j AS (SELECT rs.date, rs.r20, o.ret10 FROM rs JOIN out o ON o.symbol = rs.symbol AND o.date = rs.date WHERE ret10 IS NOT NULL), jr AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY r20) + (count(*) OVER (PARTITION BY date, r20) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY date ORDER BY ret10) + (count(*) OVER (PARTITION BY date, ret10) - 1) / 2.0 AS ry FROM j)"


@query("o7_4_spearman_by_date", f"WITH {IC} SELECT date, count(*) AS n, round(CASE WHEN count(*) >= 5 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) END, 6) AS ic FROM jr GROUP BY 1")
def spearman_by_date(spark, d):
    x = risk(spark, d).join(P.outcomes(P.bars(spark, d)).select("symbol", "date", "ret10"), ["symbol", "date"])
    return rk.spearman(x, ["date"], "r20", "ret10", least=5).select("date", "n", F.round("ic", 6).alias("ic"))


@query("o7_5_equal_count_bins", f"WITH {BINS} SELECT symbol, date, q1, q2 FROM fq")
def equal_count_bins(spark, d):
    return feature_bins(spark, d).select("symbol", "date", "q1", "q2")


@query("o7_6_bounce_bins", f"WITH {RV_OUT} SELECT symbol, date, bin FROM rbn")
def bounce_bins(spark, d):
    return reversal_classified(P.bars(spark, d)).select("symbol", "date", rk.equal_bins(["date"], ["t_day_return", "symbol"], 5).alias("bin"))


K_SQL = ", ".join(
    f"CASE WHEN any_value(n) >= {max(2, k)} THEN round(sum(ret10 * CASE WHEN score > b{k} THEN 1.0 WHEN score = b{k} THEN ({k} - ab{k}) / eq{k} ELSE 0 END / {k}), 6) END AS top{k}" for k in (1, 3, 5)
)
QUALITY = f"""pq AS (SELECT p.date, p.symbol, coalesce(dv, 0) / nullif(tv, 0) AS f1, ua / nullif(da, 0) AS f2, h2 / nullif(h1, 0) AS f3, ret10 FROM pb0 p JOIN out o ON o.symbol = p.symbol AND o.date = p.date WHERE p.rn >= 120),
pc AS (SELECT * FROM pq WHERE f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL AND ret10 IS NOT NULL),
rkd AS (SELECT *, count(*) OVER d AS n, rank() OVER (PARTITION BY date ORDER BY f1) + (count(*) OVER (PARTITION BY date, f1) - 1) / 2.0 AS r1, rank() OVER (PARTITION BY date ORDER BY f2) + (count(*) OVER (PARTITION BY date, f2) - 1) / 2.0 AS r2, rank() OVER (PARTITION BY date ORDER BY f3) + (count(*) OVER (PARTITION BY date, f3) - 1) / 2.0 AS r3 FROM pc WINDOW d AS (PARTITION BY date)),
sco AS (SELECT *, ((n - r1) + r2 + (n - r3)) / (3 * n) AS score FROM rkd),
bnd AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0 AS sr, rank() OVER (PARTITION BY date ORDER BY ret10) + (count(*) OVER (PARTITION BY date, ret10) - 1) / 2.0 AS rr, {', '.join(f'nth_value(score, {k}) OVER o AS b{k}' for k in (1, 3, 5))} FROM sco WINDOW o AS (PARTITION BY date ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
cnt AS (SELECT *, {', '.join(f'sum(CAST(score > b{k} AS INTEGER)) OVER d AS ab{k}, sum(CAST(score = b{k} AS INTEGER)) OVER d AS eq{k}' for k in (1, 3, 5))}, CAST(least(4, floor((sr - 0.5) / n * 5)) AS INTEGER) AS g, max(score) OVER d > min(score) OVER d AS varied FROM bnd WINDOW d AS (PARTITION BY date))"""


@query(
    "o7_7_quality_ranking",
    f"WITH {B}, {STEP}, {PULLBACK_SQL}, {P.NUMBERED}, {P.OUTCOMES}, {QUALITY} SELECT date, any_value(n) AS n, {K_SQL}, round(avg(ret10), 6) AS baseline, CASE WHEN any_value(n) >= 3 AND var_pop(sr) > 0 AND var_pop(rr) > 0 THEN round(covar_pop(sr, rr) / sqrt(var_pop(sr) * var_pop(rr)), 6) END AS ic, "
    + ", ".join(f"CASE WHEN any_value(n) >= 5 AND any_value(varied) THEN round(avg(ret10) FILTER (g = {q}), 6) END AS q{q + 1}" for q in range(5))
    + " FROM cnt GROUP BY date",
)
def quality_ranking(spark, d):
    """Composite of three volume ranks per date; top 1, 3 and 5 with shared boundary ties, rank IC and five bins."""
    from .q_features import pullback_features

    panel = P.kept_bars(spark, d)
    parts = stt.range_count(spark, panel.count())
    x = pullback_features(panel).where("rn >= 120").select("symbol", "date", F.col("down_volume_share").alias("f1"), F.col("up_down_mean_ratio").alias("f2"), F.col("half_mean_decay").alias("f3"))
    x = x.join(P.outcomes(panel).select("symbol", "date", "ret10"), ["symbol", "date"]).dropna().repartition(parts, "date")
    w = Window.partitionBy("date")
    x = x.withColumn("n", F.count(F.lit(1)).over(w))
    x = x.select("*", *[rk.average_rank(["date"], c).alias(f"r{c}") for c in ("f1", "f2", "f3")])
    x = x.withColumn("score", ((F.col("n") - F.col("rf1")) + F.col("rf2") + (F.col("n") - F.col("rf3"))) / (3 * F.col("n")))
    x = x.select("*", rk.average_rank(["date"], "score").alias("sr"), rk.average_rank(["date"], "ret10").alias("rr"), (F.max("score").over(w) > F.min("score").over(w)).alias("varied"))
    for k in (1, 3, 5):
        x = rk.boundary_weights(x, ["date"], "score", k).withColumnRenamed("weight", f"w{k}")
    bin_ = F.least(F.lit(4), F.floor((F.col("sr") - 0.5) / F.col("n") * 5))
    g = x.withColumn("g", bin_).groupBy("date").agg(
        F.first("n").alias("n"), *[F.round(F.sum(F.col(f"w{k}") * F.col("ret10")), 6).alias(f"t{k}") for k in (1, 3, 5)], F.round(F.avg("ret10"), 6).alias("baseline"), F.first("varied").alias("varied"),
        F.var_pop("sr").alias("vs"), F.var_pop("rr").alias("vr"), F.covar_pop("sr", "rr").alias("c"), *[F.round(F.avg(F.when(F.col("g") == q, F.col("ret10"))), 6).alias(f"b{q + 1}") for q in range(5)],
    )
    ic = F.when((F.col("n") >= 3) & (F.col("vs") > 0) & (F.col("vr") > 0), F.round(F.col("c") / F.sqrt(F.col("vs") * F.col("vr")), 6))
    return g.select(
        "date", "n", *[F.when(F.col("n") >= max(2, k), F.col(f"t{k}")).alias(f"top{k}") for k in (1, 3, 5)], "baseline", ic.alias("ic"), *[F.when((F.col("n") >= 5) & F.col("varied"), F.col(f"b{q}")).alias(f"q{q}") for q in range(1, 6)]
    )


@query(
    "o7_8_mid_rank_coordinates",
    f"WITH {RS}, x AS (SELECT symbol, date, rank() OVER (PARTITION BY date ORDER BY r20) - 1 AS less, count(*) OVER (PARTITION BY date, r20) AS eq, count(*) OVER (PARTITION BY date) AS n FROM rs), y AS (SELECT *, CASE WHEN n >= 3 THEN (less + (eq + 1) / 2.0) / n END AS p FROM x) SELECT symbol, date, round(p, 6) AS mid_rank, CASE WHEN p IS NULL THEN 'UNAVAILABLE' WHEN p <= 1.0 / 3 THEN 'LOW' WHEN p <= 2.0 / 3 THEN 'MID' ELSE 'HIGH' END AS zone FROM y",
)
def mid_rank_coordinates(spark, d):
    w = Window.partitionBy("date")
    x = risk(spark, d).select("symbol", "date", (F.rank().over(w.orderBy("r20")) - 1).alias("less"), F.count(F.lit(1)).over(Window.partitionBy("date", "r20")).alias("eq"), F.count(F.lit(1)).over(w).alias("n"))
    x = x.withColumn("p", F.when(F.col("n") >= 3, (F.col("less") + (F.col("eq") + 1) / 2) / F.col("n")))
    return x.select("symbol", "date", F.round("p", 6).alias("mid_rank"), F.when(F.col("p").isNull(), "UNAVAILABLE").when(F.col("p") <= 1 / 3, "LOW").when(F.col("p") <= 2 / 3, "MID").otherwise("HIGH").alias("zone"))


@query(
    "o7_9_joint_top_percent",
    f"WITH {BINS}, t AS (SELECT *, row_number() OVER (ORDER BY rv DESC, symbol DESC, date DESC) AS a, row_number() OVER (ORDER BY turnover DESC, symbol DESC, date DESC) AS b, ceil(0.01 * count(*) OVER ()) AS k FROM fq) SELECT symbol, date, round(rv, 6) AS rv, turnover FROM t WHERE a <= k AND b <= k",
)
def joint_top_percent(spark, d):
    x = bin_inputs(spark, d).drop("ret10")
    last = F.col("__all") - F.ceil(0.01 * F.col("__all"))  # the top percent are the rows from this place on

    def top(df, feature):
        return stt.places(df, [feature, "symbol", "date"], "__place").withColumn(f"__{feature}", F.col("__place") >= last).drop("__place", "__all")

    return top(top(x, "rv"), "turnover").where("__rv AND __turnover").select("symbol", "date", F.round("rv", 6).alias("rv"), "turnover")


PIVOT = f"pv0 AS (SELECT *, count(low) {f(-2, -1)} + count(low) {f(1, 2)} AS cnt, min(low) {f(-2, -1)} AS l1, min(low) {f(1, 2)} AS l2, max(high) {f(-2, -1)} AS h1, max(high) {f(1, 2)} AS h2 FROM nb), piv AS (SELECT symbol, date, rn, low, high, (cnt = 4 AND low <= l1 AND low <= l2) AS is_low, (cnt = 4 AND high >= h1 AND high >= h2) AS is_high FROM pv0)"


@query("o7_10_pivots", f"WITH {B}, {P.NUMBERED}, {PIVOT} SELECT symbol, date, is_low, is_high FROM piv WHERE is_low OR is_high")
def pivots(spark, d):
    return pt.pivots(P.bars(spark, d)).where("is_low OR is_high").select("symbol", "date", "is_low", "is_high")


@query(
    "o7_11_run_lengths",
    f"WITH {B}, {P.NUMBERED}, r AS (SELECT symbol, rn FROM (SELECT symbol, rn, close > lag(close) {W} AS up FROM nb) WHERE up), i AS (SELECT symbol, rn, rn - row_number() OVER (PARTITION BY symbol ORDER BY rn) AS g FROM r), l AS (SELECT symbol, g, count(*) AS length FROM i GROUP BY 1, 2) SELECT symbol, count(*) AS runs, max(length) AS longest, round(avg(length), 6) AS mean_length FROM l GROUP BY 1",
)
def run_lengths(spark, d):
    n = P.numbered(P.bars(spark, d)).withColumn("up", F.col("close") > F.lag("close").over(fx.by_symbol())).where("up")
    return rk.run_lengths(n.select("symbol", "rn"), ["symbol"], "rn").groupBy("symbol").agg(F.count(F.lit(1)).alias("runs"), F.max("length").alias("longest"), F.round(F.avg("length"), 6).alias("mean_length"))


@query(
    "o7_12_cooldown",
    f"WITH RECURSIVE {BASE}, s AS (SELECT symbol, rn FROM sig), k(symbol, rn) AS (SELECT symbol, min(rn) FROM s GROUP BY 1 UNION ALL SELECT k.symbol, (SELECT min(s.rn) FROM s WHERE s.symbol = k.symbol AND s.rn > k.rn + 10) FROM k WHERE EXISTS (SELECT 1 FROM s WHERE s.symbol = k.symbol AND s.rn > k.rn + 10)) SELECT symbol, rn FROM k",
)
def cooldown(spark, d):
    return pt.cooldown(P.signals(P.bars(spark, d)), "symbol", "rn").select("symbol", F.col("rn").cast("long").alias("rn"))


@query("o7_13_sector_ranks", f"WITH {B}, {P.SECTORS}, {P.SECTOR_RANKS} SELECT date, sector, sector_chg, sector_rank FROM sr")
def sector_ranks(spark, d):
    return P.sector_ranks(P.bars(spark, d), P.sectors(spark, d)).select("date", "sector", "sector_chg", F.col("sector_rank").cast("long").alias("sector_rank"))


@query(
    "o7_14_pareto_fronts",
    f"{LEVELS_WITH}, c AS (SELECT signal_id, date, round(rr, 12) AS h, round(risk, 12) AS l FROM lv WHERE rr IS NOT NULL AND risk IS NOT NULL), f1 AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.date = c.date AND o.h >= c.h AND o.l <= c.l AND (o.h > c.h OR o.l < c.l))), r1 AS (SELECT * FROM c ANTI JOIN f1 USING (signal_id)), f2 AS (SELECT r1.* FROM r1 WHERE NOT EXISTS (SELECT 1 FROM r1 o WHERE o.date = r1.date AND o.h >= r1.h AND o.l <= r1.l AND (o.h > r1.h OR o.l < r1.l))) "
    "SELECT signal_id, CASE WHEN signal_id IN (SELECT signal_id FROM f1) THEN 1 WHEN signal_id IN (SELECT signal_id FROM f2) THEN 2 END AS front FROM c",
)
def pareto_fronts(spark, d):
    x = signal_levels(spark, d).where("rr IS NOT NULL AND risk IS NOT NULL").select("signal_id", "date", "rr", "risk")
    return rk.pareto_fronts(x, "date", "rr", "risk", "signal_id", fronts=2).select("signal_id", "front")


@query("o7_15_next_sessions", f"WITH {B}, {P.SESSIONS} SELECT date, pos, lead(date) OVER (ORDER BY date) AS next_session, lag(date, 5) OVER (ORDER BY date) AS five_before FROM sessions")
def next_sessions(spark, d):
    w = Window.orderBy("date")
    s = P.sessions(P.bars(spark, d))
    return s.select("date", F.col("pos").cast("long").alias("pos"), F.lead("date").over(w).alias("next_session"), F.lag("date", 5).over(w).alias("five_before"))


# Top-k and sets -----------------------------------------------------------------------------------


@query("o8_1_top_symbols", f"WITH {BASE} SELECT symbol, count(*) AS n FROM sig GROUP BY 1 ORDER BY n DESC, symbol LIMIT 10")
def top_symbols(spark, d):
    return P.signals(P.bars(spark, d)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "symbol").limit(10)


@query("o8_2_best_worst_dates", f"WITH {OUT}, m AS (SELECT date, round(avg(ret5), 6) AS m FROM out WHERE ret5 IS NOT NULL GROUP BY 1) SELECT arg_max(date, (m, date)) AS best_date, max(m) AS best, arg_min(date, (m, date)) AS worst_date, min(m) AS worst FROM m")
def best_worst_dates(spark, d):
    m = P.outcomes(P.bars(spark, d)).where("ret5 IS NOT NULL").groupBy("date").agg(F.round(F.avg("ret5"), 6).alias("m"))
    return m.agg(F.max_by("date", F.struct("m", "date")).alias("best_date"), F.max("m").alias("best"), F.min_by("date", F.struct("m", "date")).alias("worst_date"), F.min("m").alias("worst"))


@query("o8_3_determinism_sample", f"WITH {B}, s AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT symbol FROM bars)) SELECT symbol, CASE WHEN p <= 4 THEN 'HEAD' WHEN p > n - 4 THEN 'TAIL' ELSE 'MIDDLE' END AS part FROM s WHERE p <= 4 OR p > n - 4 OR (p > n // 2 - 2 AND p <= n // 2 + 2)")
def determinism_sample(spark, d):
    s = P.bars(spark, d).select("symbol").distinct()
    s = s.select("symbol", F.row_number().over(Window.orderBy("symbol")).alias("p"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    half = F.floor(F.col("n") / 2)
    mid = (F.col("p") > half - 2) & (F.col("p") <= half + 2)
    return s.where((F.col("p") <= 4) | (F.col("p") > F.col("n") - 4) | mid).select("symbol", F.when(F.col("p") <= 4, "HEAD").when(F.col("p") > F.col("n") - 4, "TAIL").otherwise("MIDDLE").alias("part"))


@query("o8_4_candidate_order", f"WITH {BASE} SELECT signal_date, symbol, row_number() OVER (PARTITION BY signal_date ORDER BY symbol) AS list_position FROM sig")
def candidate_order(spark, d):
    w = Window.partitionBy("signal_date").orderBy("symbol")
    return P.signals(P.bars(spark, d)).select("signal_date", "symbol", F.row_number().over(w).cast("long").alias("list_position"))


QQ = f"{RS}, q AS (SELECT symbol, date, row_number() OVER (PARTITION BY date ORDER BY r20 DESC, symbol) <= ceil(0.2 * count(*) OVER (PARTITION BY date)) AS q20, row_number() OVER (PARTITION BY date ORDER BY r60 DESC, symbol) <= ceil(0.2 * count(*) OVER (PARTITION BY date)) AS q60 FROM rs)"


@query("o9_1_leadership_sets", f"WITH {QQ} SELECT symbol, date, CASE WHEN q20 THEN 'CANDIDATE' ELSE 'CONTROL' END AS class FROM q WHERE q60")
def leadership_sets(spark, d):
    x = risk(spark, d)
    q20 = rk.top_fraction(x, ["date"], "r20", "symbol").where("selected").select("symbol", "date")
    q60 = rk.top_fraction(x, ["date"], "r60", "symbol").where("selected").select("symbol", "date")
    return q20.intersect(q60).withColumn("class", F.lit("CANDIDATE")).unionByName(q60.exceptAll(q20).withColumn("class", F.lit("CONTROL")))


@query("o9_2_shared_bin_dates", f"WITH {RV_OUT} SELECT DISTINCT date FROM (SELECT date, bin FROM ro WHERE class = 'CANDIDATE' INTERSECT SELECT date, bin FROM ro WHERE class = 'PRIMARY_CONTROL')")
def shared_bin_dates(spark, d):
    x = reversal_outcomes(P.bars(spark, d))
    return x.where("class = 'CANDIDATE'").select("date", "bin").intersect(x.where("class = 'PRIMARY_CONTROL'").select("date", "bin")).select("date").distinct()


@query("o9_3_cleanup_plan", f"WITH {BASE}, k AS (SELECT signal_id FROM sig WHERE symbol LIKE '60%') SELECT signal_id, CASE WHEN signal_id IN (SELECT signal_id FROM k) THEN 'KEEP' ELSE 'REMOVE' END AS plan FROM sig")
def cleanup_plan(spark, d):
    s = P.signals(P.bars(spark, d)).select("signal_id", "symbol")
    keep = s.where("symbol LIKE '60%'").select("signal_id")
    return s.join(keep, "signal_id", "left_semi").select("signal_id", F.lit("KEEP").alias("plan")).unionByName(s.join(keep, "signal_id", "left_anti").select("signal_id", F.lit("REMOVE").alias("plan")))


@query("o9_4_union_of_parts", f"WITH {B}, {P.NUMBERED}, u AS (SELECT * FROM nb WHERE date < DATE '1998-01-01' UNION ALL SELECT * FROM nb WHERE date >= DATE '1998-01-01') SELECT symbol, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM u GROUP BY 1")
def union_of_parts(spark, d):
    n = P.numbered(P.bars(spark, d))
    parts = n.where("date < DATE '1998-01-01'").unionByName(n.where("date >= DATE '1998-01-01'"))
    return parts.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("o9_5_first_signal_of_episode", f"WITH {BASE}, x AS (SELECT signal_id, symbol, signal_date, row_number() OVER (PARTITION BY symbol, date_trunc('month', signal_date) ORDER BY signal_date, signal_id) AS p FROM sig) SELECT signal_id, symbol, signal_date FROM x WHERE p = 1")
def first_signal_of_episode(spark, d):
    w = Window.partitionBy("symbol", F.trunc("signal_date", "month")).orderBy("signal_date", "signal_id")
    return P.signals(P.bars(spark, d)).withColumn("p", F.row_number().over(w)).where("p = 1").select("signal_id", "symbol", "signal_date")


# Resampling ---------------------------------------------------------------------------------------


@query("o11_1_block_bootstrap")
def block_bootstrap(spark, d):
    """Confidence intervals of the daily mean return per horizon; random draws, so no SQL twin."""
    daily = long_outcomes(P.bars(spark, d)).where("ret IS NOT NULL").groupBy("horizon", "date").agg(F.avg("ret").alias("m"))
    return stt.moving_block_interval(daily, ["horizon"], "date", "m").select("horizon", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("o11_2_date_bootstrap")
def date_bootstrap(spark, d):
    """Joint intervals of four horizons' daily means; random draws, so no SQL twin."""
    daily = P.outcomes(P.bars(spark, d)).groupBy("date").agg(*[F.round(F.avg(f"ret{h}"), 9).alias(f"ret{h}") for h in (1, 3, 5, 10)])
    out = stt.date_bootstrap(daily, [f"ret{h}" for h in (1, 3, 5, 10)])
    return out.select("measure", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(
    "o11_3_quantile_table",
    f"WITH {BINS}, q AS (SELECT q1 AS bin, count(*) AS n, round(min(rv), 6) AS feature_min, round(max(rv), 6) AS feature_max, avg(ret10) AS m FROM fq GROUP BY 1) SELECT bin, n, feature_min, feature_max, round(m, 6) AS mean, round(m - (SELECT m FROM q WHERE bin = 1), 6) AS spread_to_lowest FROM q",
)
def quantile_table(spark, d):
    q = feature_bins(spark, d).groupBy(F.col("q1").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("rv"), 6).alias("feature_min"), F.round(F.max("rv"), 6).alias("feature_max"), F.avg("ret10").alias("m"))
    lowest = F.max(F.when(F.col("bin") == 1, F.col("m"))).over(Window.partitionBy())  # five rows
    return q.select("bin", "n", "feature_min", "feature_max", F.round("m", 6).alias("mean"), F.round(F.col("m") - lowest, 6).alias("spread_to_lowest"))
