"""Queries for join semantics (o5), scalars (o12) and integrity accounting (o13)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlattice.functions import scalars as sc
from barlattice.operators import execution as ex
from barlattice.operators import features as fx
from barlattice.operators import fronts
from barlattice.operators import joins as jn
from barlattice.sources import panel as P

from .q_execution import BASE, OUTCOME, PROSPECTIVE, RULE, own_path, kept_path, prospective, rule_model
from .q_features import REVERSAL_SQL
from .q_patterns import LEVELS_WITH, RVC, signal_levels
from .registry import query
from .sql import W, f

B = P.BARS
ASOF = f"{B}, {P.SESSIONS}, q AS (SELECT DISTINCT last_day(date) AS t FROM sessions)"


@query(
    "o5_1_asof_last_bar",
    f"WITH {ASOF}, y AS (SELECT DISTINCT symbol FROM bars), x AS (SELECT y.symbol, q.t FROM y CROSS JOIN q) SELECT x.symbol, x.t AS as_of, b.date AS last_bar, round(b.close, 6) AS close, b.date = x.t AS exact FROM x ASOF LEFT JOIN bars b ON b.symbol = x.symbol AND b.date <= x.t",
)
def asof_last_bar(spark, d):
    panel = P.bars(spark, d)
    ends = panel.select(F.last_day("date").alias("as_of")).distinct()
    asked = panel.select("symbol").distinct().withColumn("one", F.lit(1)).join(F.broadcast(ends.withColumn("one", F.lit(1))), "one").drop("one")  # symbols by month ends
    x = jn.asof(asked, panel.select("symbol", "date", "close"), "symbol", "as_of", "date", ["date", "close"])
    return x.select("symbol", "as_of", F.col("date").alias("last_bar"), F.round("close", 6).alias("close"), (F.col("date") == F.col("as_of")).alias("exact"))


@query(
    "o5_2_exact_coverage",
    f"WITH {BASE}, {P.SESSIONS}, x AS (SELECT s.signal_id, s.symbol, c2.date FROM sig s JOIN sessions c ON c.date = s.signal_date JOIN sessions c2 ON c2.pos BETWEEN c.pos + 1 AND c.pos + 5) SELECT signal_id, count(*) AS expected, count(b.close) AS observed, count(*) = count(b.close) AS complete FROM x LEFT JOIN bars b ON b.symbol = x.symbol AND b.date = x.date GROUP BY 1",
)
def exact_coverage(spark, d):
    panel = P.bars(spark, d)
    s = P.sessions(panel)
    path = ex.session_path(P.signals(panel), panel, s, 5).join(F.broadcast(s.select("pos")), "pos", "left_semi")
    return path.groupBy("signal_id").agg(F.count(F.lit(1)).alias("expected"), F.count("b_close").alias("observed")).withColumn("complete", F.col("expected") == F.col("observed"))


@query(
    "o5_3_dimension_joins",
    f"WITH {BASE}, {P.SECTORS}, {P.SECTOR_RANKS}, {P.INDEX} SELECT signal_id, sector, sector_rank, round(idx.close, 6) AS index_close, CASE WHEN sector IS NULL THEN 'NO_SECTOR' WHEN sector_rank IS NULL THEN 'NO_SECTOR_QUOTE' ELSE 'OK' END AS status FROM sig LEFT JOIN sec USING (symbol) LEFT JOIN sr USING (sector) JOIN idx ON idx.date = sig.signal_date WHERE sr.date = sig.signal_date",
)
def dimension_joins(spark, d):
    panel, member = P.bars(spark, d), P.sectors(spark, d)
    x = P.signals(panel).join(member, "symbol", "left")
    r = P.sector_ranks(panel, member).select("sector", F.col("date").alias("signal_date"), F.col("sector_rank").cast("long").alias("sector_rank"))
    x = x.join(r, ["sector", "signal_date"], "left").join(P.index_bars(panel).select(F.col("date").alias("signal_date"), F.round("close", 6).alias("index_close")), "signal_date", "left")
    return x.select("signal_id", "sector", "sector_rank", "index_close", F.when(F.col("sector").isNull(), "NO_SECTOR").when(F.col("sector_rank").isNull(), "NO_SECTOR_QUOTE").otherwise("OK").alias("status"))


RAW_CODE = "CASE s_suppkey % 4 WHEN 0 THEN 'sh' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') WHEN 1 THEN lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.SZ' WHEN 2 THEN ' ' || CAST(s_suppkey AS VARCHAR) WHEN 3 THEN 'SH.' || CAST(s_suppkey AS VARCHAR) END"


def raw_codes(spark, d):
    k = F.col("s_suppkey")
    six, plain = F.lpad(k.cast("string"), 6, "0"), k.cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit("sh"), six)).when(k % 4 == 1, F.concat(six, F.lit(".SZ"))).when(k % 4 == 2, F.concat(F.lit(" "), plain)).otherwise(F.concat(F.lit("SH."), plain))
    return P.read(spark, d, "supplier").select(k.alias("key"), raw.alias("raw"))


@query("o5_4_symbol_equality", "WITH c AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_suppkey FROM supplier) SELECT c.s_suppkey AS key, code, n_name AS sector FROM c JOIN supplier s ON s.s_suppkey = c.s_suppkey JOIN nation ON n_nationkey = s_nationkey")
def symbol_equality(spark, d):
    codes = raw_codes(spark, d).select("key", sc.code_only(F.col("raw")).alias("code"))
    members = P.read(spark, d, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), "s_nationkey")
    n = P.read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("sector"))
    return codes.join(members, "code").join(n, "s_nationkey").select("key", "code", "sector")


@query(
    "o5_5_last_membership_wins",
    "WITH m AS (SELECT c_nationkey, c_mktsegment, c_custkey, c_acctbal FROM customer), l AS (SELECT c_nationkey, arg_max(c_mktsegment, c_custkey) FILTER (c_acctbal > 0) AS sector, CAST(max(c_custkey) FILTER (c_acctbal > 0) AS BIGINT) AS pos FROM m WHERE c_nationkey < 20 GROUP BY 1) SELECT n_nationkey AS key, coalesce(sector, '-') AS sector, coalesce(pos, 50) AS pos FROM nation LEFT JOIN l ON c_nationkey = n_nationkey",
)
def last_membership_wins(spark, d):
    c = P.read(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("sector"), F.col("c_custkey").alias("pos"), (F.col("c_acctbal") > 0).alias("ok"))
    last = jn.last_valid(c, "key", "pos", "ok", ["sector", "pos"])
    n = P.read(spark, d, "nation").select(F.col("n_nationkey").alias("key"))
    return n.join(last, "key", "left").select("key", F.coalesce("sector", F.lit("-")).alias("sector"), F.coalesce("pos", F.lit(50)).alias("pos"))


@query("o5_6_date_join", f"WITH {B}, a AS (SELECT date, count(*) AS n60 FROM bars WHERE symbol LIKE '60%' GROUP BY 1), b AS (SELECT date, count(*) AS n68 FROM bars WHERE symbol LIKE '68%' GROUP BY 1) SELECT date, n60, n68 FROM a JOIN b USING (date)")
def date_join(spark, d):
    panel = P.bars(spark, d)
    return panel.where("symbol LIKE '60%'").groupBy("date").agg(F.count(F.lit(1)).alias("n60")).join(panel.where("symbol LIKE '68%'").groupBy("date").agg(F.count(F.lit(1)).alias("n68")), "date")


@query(
    "o5_7_membership_overlap",
    f"WITH {BASE}, {REVERSAL_SQL}, {RVC} SELECT year(signal_date) AS y, count(*) AS signals, count(*) FILTER (EXISTS (SELECT 1 FROM rvc WHERE rvc.symbol = sig.symbol AND rvc.date = sig.signal_date AND downside)) AS in_downside FROM sig GROUP BY 1",
)
def membership_overlap(spark, d):
    from .q_patterns import reversal_classified

    panel = P.bars(spark, d)
    s = P.signals(panel)
    hit = s.join(reversal_classified(panel).where("downside").select("symbol", F.col("date").alias("signal_date")), ["symbol", "signal_date"], "left_semi")
    a = s.groupBy(F.year("signal_date").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("signals"))
    b = hit.groupBy(F.year("signal_date").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("h"))
    return a.join(b, "y", "left").select("y", "signals", F.coalesce("h", F.lit(0)).alias("in_downside"))


@query(
    "o5_8_coverage_gaps",
    f"WITH {BASE}, t AS (SELECT max(date) AS t FROM bars), e AS (SELECT DISTINCT symbol FROM sig), q AS (SELECT DISTINCT symbol FROM bars, t WHERE date > t - INTERVAL 7 DAY) SELECT symbol, 'MISSING_QUOTE' AS problem FROM e ANTI JOIN q USING (symbol) UNION ALL SELECT symbol, 'EXTRA_QUOTE' FROM q ANTI JOIN e USING (symbol)",
)
def coverage_gaps(spark, d):
    panel = P.bars(spark, d)
    expected = P.signals(panel).select("symbol").distinct()
    last = panel.agg(F.max("date").alias("t"), F.lit(1).alias("one"))
    quoted = panel.withColumn("one", F.lit(1)).join(F.broadcast(last), "one").where(F.col("date") > F.date_sub("t", 7)).select("symbol").distinct()
    return jn.coverage(expected, quoted, "symbol", "MISSING_QUOTE", "EXTRA_QUOTE")


@query(
    "o5_9_event_window_join",
    f"WITH {BASE}, {P.EVENTS}, x AS (SELECT s.signal_id, s.symbol, min(b.date) AS entry, max(b.date) AS target FROM sig s JOIN nb b ON b.symbol = s.symbol AND b.rn BETWEEN s.rn + 1 AND s.rn + 10 GROUP BY 1, 2) SELECT signal_id, ev.ex_date FROM x JOIN ev ON ev.symbol = x.symbol AND ev.ex_date > entry AND ev.ex_date <= target",
)
def event_window_join(spark, d):
    from .q_patterns import after_signals

    x = after_signals(P.bars(spark, d), 10).groupBy("signal_id", "symbol").agg(F.min("b_date").alias("entry"), F.max("b_date").alias("target"))
    # An equality join on the symbol, which has a handful of events, with the window as a filter.
    return x.join(P.corporate_events(spark, d).select("symbol", "ex_date"), "symbol").where("ex_date > entry AND ex_date <= target").select("signal_id", "ex_date")


@query(
    "o5_11_dominance",
    f"{LEVELS_WITH}, c AS (SELECT signal_id, date, round(rr, 9) AS h, round(risk, 9) AS l FROM lv WHERE rr IS NOT NULL AND risk IS NOT NULL) SELECT c.signal_id, (SELECT count(*) FROM c o WHERE o.date = c.date AND o.h >= c.h AND o.l <= c.l AND (o.h > c.h OR o.l < c.l)) AS dominated_by FROM c",
)
def dominance(spark, d):
    x = signal_levels(spark, d).where("rr IS NOT NULL AND risk IS NOT NULL").select("signal_id", "date", F.round("rr", 9).alias("h"), (-F.round("risk", 9)).alias("l"))
    return fronts.dominator_counts(x, "date", "signal_id", ["h", "l"]).select("signal_id", F.col("n_dominators").alias("dominated_by"))


def model_pairs(spark, d):
    path = kept_path(spark, d, 30)
    p, r = prospective(spark, d, path.where("step <= 11")), rule_model(spark, d, path)
    return jn.pair_models(p, r)


@query(
    "o5_12_model_pairs",
    f"WITH p AS (WITH {PROSPECTIVE} SELECT * FROM rp), r AS (WITH {RULE} SELECT * FROM rp) SELECT coalesce(p.signal_id, r.signal_id) AS signal_id, p.status AS prospective_status, r.status AS rule_status, p.return_pct AS prospective_return, r.return_pct AS rule_return, CASE WHEN p.status = r.status THEN 'SAME_STATUS' WHEN p.entry_step IS DISTINCT FROM r.entry_step THEN 'DIFFERENT_ENTRY' ELSE 'DIFFERENT_EXIT' END AS category FROM p FULL JOIN r ON p.signal_id = r.signal_id",
)
def model_pair_rows(spark, d):
    return model_pairs(spark, d)


@query(
    "o5_13_merge_sources",
    f"WITH {B}, {P.NUMBERED}, a AS (SELECT symbol, date, close FROM nb WHERE rn % 5 <> 0), b AS (SELECT symbol, date, close + CASE WHEN rn % 7 = 0 THEN 0.01 ELSE 0 END AS close FROM nb WHERE rn % 3 <> 0) SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.date, b.date) AS date, round(coalesce(b.close, a.close), 6) AS close, CASE WHEN b.close IS NULL THEN 'FIRST_ONLY' WHEN a.close IS NULL THEN 'SECOND_ONLY' WHEN abs(a.close - b.close) <= 1e-9 THEN 'SAME' ELSE 'CONFLICT' END AS status FROM a FULL JOIN b ON a.symbol = b.symbol AND a.date = b.date",
)
def merge_sources(spark, d):
    n = P.numbered(P.bars(spark, d))
    a = n.where("rn % 5 <> 0").select("symbol", "date", "close")
    b = n.where("rn % 3 <> 0").select("symbol", "date", (F.col("close") + F.when(F.col("rn") % 7 == 0, 0.01).otherwise(0.0)).alias("close"))
    return jn.merge_sources(a, b, ["symbol", "date"], "close").withColumn("close", F.round("close", 6))


@query(
    "o5_14_observation_join",
    f"WITH {BASE}, y AS (SELECT signal_id, symbol, signal_date, lead(date) OVER (PARTITION BY symbol ORDER BY date) AS nxt FROM nb LEFT JOIN sig USING (symbol, rn)) SELECT signal_id, nxt AS observed_on, round(b.close, 6) AS close FROM y LEFT JOIN bars b ON b.symbol = y.symbol AND b.date = y.nxt WHERE signal_id IS NOT NULL",
)
def observation_join(spark, d):
    panel = P.bars(spark, d)
    seen = panel.select("symbol", F.col("date").alias("signal_date"), F.lead("date").over(fx.by_symbol()).alias("observed_on"), F.round(F.lead("close").over(fx.by_symbol()), 6).alias("close"))
    return P.signals(panel).select("signal_id", "symbol", "signal_date").join(seen, ["symbol", "signal_date"], "left").select("signal_id", "observed_on", "close")


@query(
    "o5_15_version_diff",
    f"WITH a AS (WITH {BASE}, {own_path(10)} " + OUTCOME.format("step", "CROSS JOIN (SELECT CAST(NULL AS BIGINT) AS reach)", "FALSE") + "), b AS (SELECT signal_id, horizon, return_pct + CASE WHEN horizon = 5 THEN 0.5 ELSE 0 END AS return_pct FROM a) SELECT a.horizon, count(*) AS n, count(*) FILTER (abs(a.return_pct - b.return_pct) > 1e-12) AS changed, round(avg(b.return_pct - a.return_pct), 6) AS mean_delta FROM a JOIN b USING (signal_id, horizon) GROUP BY 1",
)
def version_diff(spark, d):
    from .q_execution import own_clock_outcomes

    a = own_clock_outcomes(spark, d).select("signal_id", "horizon", "return_pct")
    b = a.withColumn("return_pct", F.col("return_pct") + F.when(F.col("horizon") == 5, 0.5).otherwise(0.0))
    x = jn.keyed_diff(a, b, ["signal_id", "horizon"], "return_pct", 1e-12)
    return x.groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("changed")).alias("changed"), F.round(F.avg("delta"), 6).alias("mean_delta"))


@query(
    "o5_16_price_compatibility",
    f"WITH {BASE}, q AS (SELECT symbol, date, close * CASE WHEN rn % 50 = 0 THEN 1.01 ELSE 1 END AS qc, high AS qh, low AS ql FROM nb) SELECT count(*) AS n, count(*) FILTER (abs(q.qc - sig.close) <= 1e-9) AS close_equal, count(*) FILTER (abs(round(q.qh * 1.0005, 4) - sig.trigger) <= 1e-9) AS trigger_equal, count(*) FILTER (abs(round(q.ql * 0.995, 4) - sig.stop) <= 1e-9) AS stop_equal FROM sig JOIN q ON q.symbol = sig.symbol AND q.date = sig.signal_date",
)
def price_compatibility(spark, d):
    panel = P.bars(spark, d)
    q = P.numbered(panel).select("symbol", F.col("date").alias("signal_date"), (F.col("close") * F.when(F.col("rn") % 50 == 0, 1.01).otherwise(1.0)).alias("qc"), F.col("high").alias("qh"), F.col("low").alias("ql"))
    x = P.signals(panel).join(q, ["symbol", "signal_date"])

    def same(a, b):
        return F.count_if(F.abs(a - b) <= 1e-9)

    return x.agg(F.count(F.lit(1)).alias("n"), same(F.col("qc"), F.col("close")).alias("close_equal"), same(F.round(F.col("qh") * 1.0005, 4), F.col("trigger")).alias("trigger_equal"), same(F.round(F.col("ql") * 0.995, 4), F.col("stop")).alias("stop_equal"))


# Scalars ------------------------------------------------------------------------------------------


@query("o12_1_codes", f"SELECT s_suppkey AS key, {RAW_CODE} AS raw, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || CASE WHEN lpad(CAST(s_suppkey AS VARCHAR), 6, '0')[1] = '6' THEN '.SH' WHEN lpad(CAST(s_suppkey AS VARCHAR), 6, '0')[1] IN ('0', '3') THEN '.SZ' ELSE '.BJ' END AS full_code FROM supplier")
def codes(spark, d):
    x = raw_codes(spark, d).withColumn("code", sc.code_only(F.col("raw")))
    return x.select("key", "raw", "code", sc.with_exchange(F.col("code")).alias("full_code"))


@query("o12_2_display_names", "SELECT c_custkey AS key, c_name AS name FROM customer")
def display_names(spark, d):
    wide = F.translate(F.col("c_name"), "0123456789#", "０１２３４５６７８９＃")
    return P.read(spark, d, "customer").select(F.col("c_custkey").alias("key"), sc.display_name(F.concat(F.lit("​ "), wide)).alias("name"))


@query("o12_3_dates", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders")
def dates(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, F.concat(F.lit("x"), F.date_format("o_orderdate", "yyyyMMdd"))).when(k % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return P.read(spark, d, "orders").select(k.alias("key"), sc.canonical_date(text).alias("date"))


@query("o12_4_session_spans", f"WITH {BASE}, {P.SESSIONS}, n AS (SELECT symbol, date, lead(date) OVER (PARTITION BY symbol ORDER BY date) AS nxt FROM bars) SELECT signal_id, b.pos - a.pos AS sessions_exclusive, b.pos - a.pos + 1 AS sessions_inclusive FROM sig JOIN n ON n.symbol = sig.symbol AND n.date = sig.signal_date JOIN sessions a ON a.date = n.date JOIN sessions b ON b.date = n.nxt")
def session_spans(spark, d):
    panel = P.bars(spark, d)
    s = P.sessions(panel)
    n = panel.select("symbol", F.col("date").alias("signal_date"), F.lead("date").over(fx.by_symbol()).alias("nxt"))
    x = P.signals(panel).join(n, ["symbol", "signal_date"]).join(F.broadcast(s.select(F.col("date").alias("signal_date"), F.col("pos").alias("a"))), "signal_date").join(F.broadcast(s.select(F.col("date").alias("nxt"), F.col("pos").alias("b"))), "nxt")
    gap = (F.col("b") - F.col("a")).cast("long")
    return x.select("signal_id", gap.alias("sessions_exclusive"), (gap + 1).alias("sessions_inclusive"))


@query("o12_5_canonical_hash", "SELECT s_suppkey AS key, sha256('{\"name\":\"' || s_name || '\",\"nation\":' || CAST(s_nationkey AS VARCHAR) || '}') AS content_sha256 FROM supplier")
def canonical_hash(spark, d):
    s = P.read(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("key"), F.sha2(F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))), 256).alias("content_sha256"))


@query("o12_6_numbers", "WITH t AS (SELECT o_orderkey AS key, CASE o_orderkey % 6 WHEN 0 THEN 'NaN' WHEN 1 THEN '' WHEN 2 THEN ' 12.5 ' WHEN 3 THEN '-3' WHEN 4 THEN 'abc' ELSE CAST(o_orderkey AS VARCHAR) END AS text FROM orders) SELECT key, CASE WHEN text IN ('NaN', '', 'abc') THEN NULL ELSE CAST(trim(text) AS DOUBLE) END AS number, CASE WHEN text IN ('NaN', '', 'abc', '-3') THEN NULL ELSE CAST(trim(text) AS DOUBLE) END AS positive FROM t")
def numbers(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 6 == 0, "NaN").when(k % 6 == 1, "").when(k % 6 == 2, " 12.5 ").when(k % 6 == 3, "-3").when(k % 6 == 4, "abc").otherwise(k.cast("string"))
    return P.read(spark, d, "orders").select(k.alias("key"), sc.number(text).alias("number"), sc.number(text, positive=True).alias("positive"))


@query("o12_7_json_paths", "SELECT event_id AS key, json_extract_string(props, '$.k') AS k, try_cast(json_extract_string(props, '$.v') AS DOUBLE) AS v FROM events")
def json_paths(spark, d):
    return P.read(spark, d, "events").select(F.col("event_id").alias("key"), F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.v").try_cast("double").alias("v"))


@query("o12_8_ratio_reasons", f"WITH {B}, x AS (SELECT symbol, date, close - lag(close) {W} AS a, lag(close) {W} - lag(close, 2) {W} AS b FROM bars) SELECT symbol, date, CASE WHEN a IS NOT NULL AND b > 0 THEN round(a / b, 6) END AS ratio, CASE WHEN a IS NULL THEN 'MISSING_NUMERATOR' WHEN b IS NULL THEN 'MISSING_DENOMINATOR' WHEN b <= 0 THEN 'NON_POSITIVE_DENOMINATOR' END AS reason, CAST(sign(a) AS DOUBLE) AS direction FROM x")
def ratio_reasons(spark, d):
    c, w = F.col("close"), fx.by_symbol()
    x = P.bars(spark, d).select("symbol", "date", (c - F.lag("close").over(w)).alias("a"), (F.lag("close").over(w) - F.lag("close", 2).over(w)).alias("b"))
    ratio, reason = sc.ratio_with_reason(F.col("a"), F.col("b"))
    return x.select("symbol", "date", F.round(ratio, 6).alias("ratio"), reason.alias("reason"), F.signum("a").alias("direction"))


# Integrity ----------------------------------------------------------------------------------------


@query("o13_1_watchlist_validation", f"WITH {BASE} SELECT signal_id, CASE WHEN NOT (stop < trigger) THEN 'STOP_NOT_BELOW_TRIGGER' WHEN NOT (trigger < target) THEN 'TARGET_NOT_ABOVE_TRIGGER' WHEN signal_id <> symbol || ':' || CAST(signal_date AS VARCHAR) THEN 'BAD_SIGNAL_ID' ELSE 'VALID' END AS status FROM sig")
def watchlist_validation(spark, d):
    s = P.signals(P.bars(spark, d))
    own = F.concat_ws(":", "symbol", F.col("signal_date").cast("string"))
    return s.select("signal_id", F.when(~(F.col("stop") < F.col("trigger")), "STOP_NOT_BELOW_TRIGGER").when(~(F.col("trigger") < F.col("target")), "TARGET_NOT_ABOVE_TRIGGER").when(F.col("signal_id") != own, "BAD_SIGNAL_ID").otherwise("VALID").alias("status"))


@query("o13_2_freeze_checks", f"WITH {B}, {P.NUMBERED}, c AS (SELECT date, count(*) AS evaluated, count(*) FILTER (rn < 120) AS short_history FROM nb GROUP BY 1) SELECT date, CASE WHEN dayofweek(date) IN (0, 6) THEN 'WEEKEND_BACKFILL' WHEN short_history = evaluated THEN 'NO_COVERAGE' ELSE 'FREEZABLE' END AS status, round(1 - short_history / evaluated, 6) AS coverage FROM c")
def freeze_checks(spark, d):
    c = P.numbered(P.bars(spark, d)).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rn") < 120).alias("short"))
    status = F.when(F.dayofweek("date").isin(1, 7), "WEEKEND_BACKFILL").when(F.col("short") == F.col("n"), "NO_COVERAGE").otherwise("FREEZABLE")
    return c.select("date", status.alias("status"), F.round(1 - F.col("short") / F.col("n"), 6).alias("coverage"))


@query("o13_3_evidence_checks", f"WITH {BASE}, {P.EVENTS} SELECT signal_id, CASE WHEN count(ev.ex_date) FILTER (ev.ex_date > signal_date) > 0 THEN 'FORBID_LATER_ADJUSTED_HISTORY' ELSE 'POINT_IN_TIME_OK' END AS status FROM sig LEFT JOIN ev USING (symbol) GROUP BY 1")
def evidence_checks(spark, d):
    x = P.signals(P.bars(spark, d)).join(P.corporate_events(spark, d).select("symbol", "ex_date"), "symbol", "left")
    g = x.groupBy("signal_id").agg(F.count_if(F.col("ex_date") > F.col("signal_date")).alias("later"))
    return g.select("signal_id", F.when(F.col("later") > 0, "FORBID_LATER_ADJUSTED_HISTORY").otherwise("POINT_IN_TIME_OK").alias("status"))


@query("o13_4_identity_conflicts", "WITH a AS (SELECT c_custkey AS key, c_mktsegment AS v FROM customer), b AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 9 = 0 THEN 'OTHER' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 10 <> 0) SELECT key, CASE WHEN b.v IS NULL THEN 'NOT_PERSISTED' WHEN a.v <> b.v THEN 'CONFLICT' END AS conflict FROM a LEFT JOIN b USING (key) WHERE b.v IS NULL OR a.v <> b.v")
def identity_conflicts(spark, d):
    k = F.col("c_custkey")
    a = P.read(spark, d, "customer").select(k.alias("key"), F.col("c_mktsegment").alias("v"))
    b = P.read(spark, d, "customer").where("c_custkey % 10 <> 0").select(k.alias("key"), F.when(k % 9 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("w"))
    x = a.join(b, "key", "left")
    return x.where("w IS NULL OR v <> w").select("key", F.when(F.col("w").isNull(), "NOT_PERSISTED").otherwise("CONFLICT").alias("conflict"))


@query("o13_5_stream_identity", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def stream_identity(spark, d):
    return P.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(
    "o13_6_pending_is_not_zero",
    f"WITH {BASE}, {P.SESSIONS}, c AS (SELECT signal_date AS date, count(*) AS n FROM sig GROUP BY 1), e AS (SELECT date, count(*) FILTER (rn >= 120) AS evaluable FROM nb GROUP BY 1) SELECT s.date, CASE WHEN evaluable > 0 THEN coalesce(c.n, 0) END AS matched, CASE WHEN evaluable = 0 THEN 'PENDING' WHEN c.n IS NULL THEN 'NONE' ELSE 'MATCH' END AS status FROM sessions s JOIN e USING (date) LEFT JOIN c USING (date)",
)
def pending_is_not_zero(spark, d):
    panel = P.bars(spark, d)
    e = P.numbered(panel).groupBy("date").agg(F.count_if(F.col("rn") >= 120).alias("evaluable"))
    c = P.signals(panel).groupBy(F.col("signal_date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    x = e.join(c, "date", "left")
    return x.select("date", F.when(F.col("evaluable") > 0, F.coalesce("n", F.lit(0))).alias("matched"), F.when(F.col("evaluable") == 0, "PENDING").when(F.col("n").isNull(), "NONE").otherwise("MATCH").alias("status"))


@query(
    "o13_7_replay_parity",
    f"WITH {BASE}, {P.OUTCOMES}, {own_path(10)}, fo AS (" + OUTCOME.format("step", "CROSS JOIN (SELECT CAST(NULL AS BIGINT) AS reach)", "FALSE") + ") SELECT count(*) AS compared, count(*) FILTER (fo.return_pct IS DISTINCT FROM round(o.ret10, 6)) AS differing FROM fo JOIN sig USING (signal_id) JOIN out o ON o.symbol = sig.symbol AND o.date = sig.signal_date WHERE fo.horizon = 10",
)
def replay_parity(spark, d):
    """The two evaluators of a fixed outcome (lead windows, joined paths) must give the same returns."""
    from .q_execution import own_clock_outcomes

    panel = P.bars(spark, d)
    a = own_clock_outcomes(spark, d).where("horizon = 10").select("signal_id", F.col("return_pct").alias("a"))
    b = P.outcomes(panel).select(F.concat_ws(":", "symbol", F.col("date").cast("string")).alias("signal_id"), F.round("ret10", 6).alias("b"))
    return a.join(b, "signal_id").agg(F.count(F.lit(1)).alias("compared"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing"))


@query("o13_8_locked_backfill", f"WITH {BASE}, v AS (SELECT symbol, rn, count(*) OVER w AS n, avg(volume) OVER w AS m FROM nb WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT signal_id, round(v.m, 6) AS mean_volume10, CASE WHEN v.n < 10 THEN 'INSUFFICIENT_BARS' ELSE 'OK' END AS status FROM sig JOIN v USING (symbol, rn)")
def locked_backfill(spark, d):
    panel = P.bars(spark, d)
    w = Window.partitionBy("symbol").orderBy("rn").rowsBetween(-9, 0)
    v = P.numbered(panel).select("symbol", "rn", F.count("volume").over(w).alias("n"), F.avg("volume").over(w).alias("m"))
    return P.signals(panel).join(v, ["symbol", "rn"]).select("signal_id", F.round("m", 6).alias("mean_volume10"), F.when(F.col("n") < 10, "INSUFFICIENT_BARS").otherwise("OK").alias("status"))
