"""Queries for sources and sinks (o1) and point-in-time panels (o2)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlattice.operators import adjust, features as fx
from barlattice.sources import files, panel as P

from .registry import query
from .sql import W, f, rounded

B = P.BARS


@query(
    "o1_1_bar_scan",
    f"WITH {B} SELECT count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, count(*) - count(DISTINCT (symbol, date)) AS duplicate_keys, count(*) FILTER (close IS NULL OR open IS NULL) AS null_prices, "
    "count(*) FILTER (least(open, high, low, close) <= 0) AS bad_prices, count(*) FILTER (volume < 0) AS bad_volume, count(*) FILTER (high < greatest(open, close) OR low > least(open, close)) AS bad_bounds, min(date) AS first_date, max(date) AS last_date FROM bars",
)
def bar_scan(spark, d):
    return files.audit_bars(P.bars(spark, d))


@query("o1_2_index_union", f"WITH {B}, {P.INDEX} SELECT date, round(close, 6) AS close, round(volume, 6) AS volume FROM idx")
def index_union(spark, d):
    index = P.index_bars(P.bars(spark, d)).select("date", F.round("close", 6).alias("close"), F.round("volume", 6).alias("volume"))
    yearly = index.groupBy(F.year("date").alias("y")).agg(F.to_json(F.struct(F.lit(0).alias("code"), F.struct(F.collect_list(F.struct("date", "close", "volume")).alias("item")).alias("data"))).alias("payload"))
    return files.index_from_payloads(yearly.select("payload"))


@query("o1_3_corporate_events", f"WITH {P.EVENTS} SELECT symbol, ex_date, round(dividend, 6) AS dividend, bonus, allotment, allotment_price, row_number() OVER (PARTITION BY symbol ORDER BY ex_date) AS seq FROM ev")
def corporate_events(spark, d):
    w = Window.partitionBy("symbol").orderBy("ex_date")
    return P.corporate_events(spark, d).select("symbol", "ex_date", F.round("dividend", 6).alias("dividend"), "bonus", "allotment", "allotment_price", F.row_number().over(w).cast("long").alias("seq"))


@query(
    "o1_4_quote_lines",
    f"WITH {B}, {P.NUMBERED} SELECT symbol AS code, CASE WHEN rn % 11 = 0 THEN NULL ELSE round(close, 4) END AS price, CASE WHEN rn % 11 = 0 OR rn % 13 = 0 THEN NULL ELSE date END AS quote_date, "
    "CASE WHEN rn % 13 = 0 THEN 'TOO_FEW_FIELDS' WHEN rn % 11 = 0 THEN 'BAD_PRICE' ELSE 'OK' END AS status FROM nb WHERE rn % 13 <> 0 UNION ALL SELECT symbol, NULL, NULL, 'TOO_FEW_FIELDS' FROM nb WHERE rn % 13 = 0",
)
def quote_lines(spark, d):
    n = P.numbered(P.bars(spark, d))
    price = F.when(F.col("rn") % 11 == 0, "n/a").otherwise(F.round("close", 4).cast("string"))
    front = [F.lit("1"), F.col("symbol"), F.col("symbol"), price]
    filler = F.repeat(F.lit("~0"), 26)
    stamp = F.concat(F.date_format("date", "yyyyMMdd"), F.lit("150000"))
    whole = F.concat(F.concat_ws("~", *front), filler, F.lit("~"), stamp, F.repeat(F.lit("~0"), 20))
    line = F.concat(F.lit("v_x=\""), F.when(F.col("rn") % 13 == 0, F.concat_ws("~", *front)).otherwise(whole), F.lit("\""))
    return files.parse_quotes(n.select(line.alias("value")))


@query(
    "o1_5_watchlist_documents",
    f"WITH {B}, {P.NUMBERED}, {P.SIGNALS}, w AS (SELECT signal_date, count(*) AS n FROM sig GROUP BY 1) SELECT signal_date, n AS n_candidates, CASE WHEN dayofyear(signal_date) % 7 = 0 THEN 'DATE_MISMATCH' ELSE 'OK' END AS status FROM w",
)
def watchlist_documents(spark, d):
    s = P.signals(P.bars(spark, d))
    docs = s.groupBy("signal_date").agg(F.collect_list(F.struct(F.col("symbol").alias("code"), "trigger", "stop", "target")).alias("candidates"))
    named = F.when(F.dayofyear("signal_date") % 7 == 0, F.date_add("signal_date", 1)).otherwise(F.col("signal_date"))
    docs = docs.select(F.concat(F.lit("watchlist_"), F.date_format(named, "yyyyMMdd"), F.lit(".json")).alias("file"), F.to_json(F.struct(F.col("signal_date").alias("date"), "candidates")).alias("payload"))
    return files.watchlists(docs)


@query(
    "o1_7_content_hash",
    f"WITH {B}, l AS (SELECT symbol, symbol || '|' || CAST(date AS VARCHAR) || '|' || CAST(CAST(round(close * 10000) AS BIGINT) AS VARCHAR) AS line FROM bars) SELECT symbol, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY line)) AS content_sha256 FROM l GROUP BY 1",
)
def content_hash(spark, d):
    line = F.concat_ws("|", "symbol", F.col("date").cast("string"), F.round(F.col("close") * 10000).cast("long").cast("string"))
    return files.content_hash(P.bars(spark, d).select("symbol", line.alias("line")), ["symbol"])


DUP = "SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT (l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS n_values FROM lineitem GROUP BY 1, 2"


@query("o1_8_canonical_payload_rows", f"WITH k AS ({DUP}) SELECT l_orderkey, l_linenumber, n AS n_rows, CASE WHEN n = 1 THEN 'UNIQUE' WHEN n_values = 1 THEN 'EXACT_DUPLICATE' ELSE 'CONFLICT' END AS status FROM k")
def canonical_payload_rows(spark, d):
    return files.duplicate_status(P.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])


@query("o1_9_duplicate_collapse", f"WITH k AS ({DUP}), s AS (SELECT CASE WHEN n = 1 THEN 'UNIQUE' WHEN n_values = 1 THEN 'EXACT_DUPLICATE' ELSE 'CONFLICT' END AS status, n FROM k) SELECT status, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_collapsed FROM s GROUP BY 1")
def duplicate_collapse(spark, d):
    return canonical_payload_rows(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n_rows").alias("n_rows"), F.sum(F.col("n_rows") - 1).alias("n_collapsed"))


@query(
    "o1_10_payload_schema_audit",
    "WITH p AS (SELECT CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN 'n/a' WHEN o_orderkey % 23 = 0 THEN '-1' ELSE CAST(o_orderkey % 50 AS VARCHAR) END AS v FROM orders) "
    "SELECT d AS trade_date, count(*) AS n_rows, count(*) FILTER (v = '') AS n_blank, count(*) FILTER (v <> '' AND try_cast(v AS DOUBLE) IS NULL) AS n_non_numeric, count(*) FILTER (try_cast(v AS DOUBLE) < 0) AS n_negative FROM p GROUP BY 1",
)
def payload_schema_audit(spark, d):
    k = F.col("o_orderkey")
    v = F.when(k % 17 == 0, "").when(k % 19 == 0, "n/a").when(k % 23 == 0, "-1").otherwise((k % 50).cast("string"))
    return files.audit_values(P.read(spark, d, "orders").select(F.to_date("o_orderdate").alias("trade_date"), v.alias("value")))


@query(
    "o1_11_result_summary",
    f"WITH {B}, {P.NUMBERED} SELECT year(date) AS y, count(*) AS n_rows, count(*) FILTER (rn >= 120) AS n_evaluable, min(date) AS first_date, max(date) AS last_date FROM nb GROUP BY 1",
)
def result_summary(spark, d):
    n = P.numbered(P.bars(spark, d))
    return n.groupBy(F.year("date").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("rn") >= 120).alias("n_evaluable"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("o1_12_csv_lines", f"WITH {B}, {P.NUMBERED}, {P.SIGNALS} SELECT signal_id || ',' || symbol || ',' || CAST(signal_date AS VARCHAR) || ',' || CAST(CAST(round(trigger * 10000) AS BIGINT) AS VARCHAR) AS line FROM sig")
def csv_lines(spark, d):
    s = P.signals(P.bars(spark, d)).select("signal_id", "symbol", F.col("signal_date").cast("string"), F.round(F.col("trigger") * 10000).cast("long").alias("trigger"))
    return s.select(F.to_csv(F.struct("signal_id", "symbol", "signal_date", "trigger")).alias("line"))


@query(
    "o1_14_alias_records",
    "WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS name, CASE WHEN c_custkey % 3 = 1 THEN c_name END AS display_name, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS price FROM customer), n AS (SELECT c_custkey AS key, coalesce(name, display_name) AS name, price FROM r) "
    "SELECT key, name, price, CASE WHEN name IS NULL THEN 'MISSING_NAME' WHEN price IS NULL THEN 'MISSING_PRICE' WHEN price <= 0 THEN 'NON_POSITIVE_PRICE' END AS excluded_reason FROM n",
)
def alias_records(spark, d):
    k = F.col("c_custkey")
    raw = P.read(spark, d, "customer").select(k.alias("key"), F.when(k % 3 == 0, F.col("c_name")).alias("name"), F.when(k % 3 == 1, F.col("c_name")).alias("display_name"), F.when(k % 5 > 0, F.col("c_acctbal")).alias("price"))
    return files.normalise_records(raw, {"key": ["key"], "name": ["name", "display_name"], "price": ["price"]})


def adjusted_sql(price: str, date: str, anchor: str, last: str) -> str:
    """Two events at most, in order, as nested CASEs (each symbol has two)."""
    one = f"CASE WHEN e1.ex_date > {date} AND e1.ex_date <= {anchor} THEN ({price} - e1.dividend + e1.allotment_price * e1.allotment) / (1 + e1.bonus + e1.allotment) ELSE {price} END"
    return f"CASE WHEN e2.ex_date > {date} AND e2.ex_date <= {anchor} THEN (({one}) - e2.dividend + e2.allotment_price * e2.allotment) / (1 + e2.bonus + e2.allotment) ELSE {one} END AS {last}"


E12 = "e1 AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ex_date) = 1), e2 AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ex_date) = 2)"
ANCHOR = "1997-06-30"


@query(
    "o2_1_anchor_adjusted",
    f"WITH {B}, {P.EVENTS}, {E12}, a AS (SELECT b.symbol, b.date, {', '.join(adjusted_sql('b.' + p, 'b.date', f"DATE '{ANCHOR}'", p) for p in ('open', 'high', 'low', 'close'))}, b.volume FROM bars b LEFT JOIN e1 ON b.symbol = e1.symbol LEFT JOIN e2 ON b.symbol = e2.symbol WHERE b.date <= DATE '{ANCHOR}') "
    f"SELECT symbol, date, {rounded('open high low close volume')} FROM a",
)
def anchor_adjusted(spark, d):
    x = adjust.anchor_adjusted(P.bars(spark, d), P.corporate_events(spark, d), F.lit(ANCHOR).cast("date"))
    return x.select("symbol", "date", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close", "volume")])


@query("o2_2_universe", f"WITH {B}, {P.NUMBERED} SELECT symbol, date, least(rn, 260) AS bars_used FROM nb WHERE rn >= 120")
def universe(spark, d):
    return P.numbered(P.bars(spark, d)).where("rn >= 120").select("symbol", "date", F.least("rn", F.lit(260)).cast("long").alias("bars_used"))


STATES = """s0 AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS k, DATE '1900-01-01' AS from_date FROM ev UNION ALL SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ex_date) AS k, ex_date FROM ev),
stt AS (SELECT *, lead(from_date) OVER (PARTITION BY symbol ORDER BY k) AS to_date FROM s0)"""


@query(
    "o2_3_state_features",
    f"WITH {B}, {P.NUMBERED}, {P.EVENTS}, {E12}, {STATES}, sg AS (SELECT nb.symbol, nb.date, nb.rn, k, from_date FROM nb JOIN stt ON nb.symbol = stt.symbol AND nb.date >= from_date AND (to_date IS NULL OR nb.date < to_date)), "
    f"bd AS (SELECT symbol, k, min(rn) AS lo, max(rn) AS hi, max(from_date) AS anchor FROM sg GROUP BY 1, 2), hs AS (SELECT b.symbol, bd.k, b.date, b.rn, b.rn >= bd.lo AS is_signal, {adjusted_sql('b.close', 'b.date', 'bd.anchor', 'close')} FROM nb b JOIN bd ON b.symbol = bd.symbol AND b.rn > bd.lo - 260 AND b.rn <= bd.hi LEFT JOIN e1 ON b.symbol = e1.symbol LEFT JOIN e2 ON b.symbol = e2.symbol), "
    "w AS (SELECT *, avg(close) OVER (PARTITION BY symbol, k ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma20, max(close) OVER (PARTITION BY symbol, k ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS prev60_hi_c FROM hs) SELECT symbol, k, date, round(close, 6) AS close, round(ma20, 6) AS ma20, round(prev60_hi_c, 6) AS prev60_hi_c FROM w WHERE is_signal AND rn >= 120",
)
def state_features(spark, d):
    h = adjust.state_history(P.bars(spark, d), P.corporate_events(spark, d))
    w = Window.partitionBy("symbol", "k").orderBy("date")
    x = h.withColumn("ma20", F.avg("close").over(w.rowsBetween(-19, 0))).withColumn("prev60_hi_c", F.max("close").over(w.rowsBetween(-60, -1))).where("is_signal AND rn >= 120")
    return x.select("symbol", "k", "date", *[F.round(c, 6).alias(c) for c in ("close", "ma20", "prev60_hi_c")])


@query(
    "o2_4_target_adjusted_path",
    f"WITH {B}, {P.NUMBERED}, {P.EVENTS}, {E12}, {P.SIGNALS}, p AS (SELECT s.signal_id, b.symbol, b.date, b.rn - s.rn AS step, b.open, b.close, max(b.date) OVER (PARTITION BY s.signal_id) AS target_date, min(b.date) OVER (PARTITION BY s.signal_id) AS entry_date, count(*) OVER (PARTITION BY s.signal_id) AS n FROM sig s JOIN nb b ON b.symbol = s.symbol AND b.rn BETWEEN s.rn + 1 AND s.rn + 10), "
    f"q AS (SELECT p.*, {adjusted_sql('p.open', 'p.date', 'p.target_date', 'aopen')}, {adjusted_sql('p.close', 'p.date', 'p.target_date', 'aclose')}, CAST(coalesce(e1.ex_date > p.entry_date AND e1.ex_date <= p.target_date, FALSE) AS BIGINT) + CAST(coalesce(e2.ex_date > p.entry_date AND e2.ex_date <= p.target_date, FALSE) AS BIGINT) AS crossings FROM p LEFT JOIN e1 ON p.symbol = e1.symbol LEFT JOIN e2 ON p.symbol = e2.symbol WHERE n = 10) "
    "SELECT signal_id, round((max(CASE WHEN step = 10 THEN aclose END) / max(CASE WHEN step = 1 THEN aopen END) - 1) * 100, 6) AS return_pct, max(crossings) AS crossings FROM q GROUP BY 1",
)
def target_adjusted_path(spark, d):
    panel = P.bars(spark, d)
    s, b = P.signals(panel).alias("s"), P.numbered(panel).alias("b")
    # An equality join on (symbol, place): each signal lists the ten places it needs.
    s = s.select("s.signal_id", "s.symbol", F.posexplode(F.sequence(F.col("s.rn") + 1, F.col("s.rn") + 10)).alias("step", "rn"))
    p = s.join(b, ["symbol", "rn"])
    w = Window.partitionBy("signal_id")
    p = p.withColumn("target_date", F.max("date").over(w)).withColumn("entry_date", F.min("date").over(w)).withColumn("n", F.count(F.lit(1)).over(w)).where("n = 10")
    p = adjust.with_events(p, P.corporate_events(spark, d))
    crossing = F.size(F.filter("events", lambda e: (e["ex_date"] > F.col("entry_date")) & (e["ex_date"] <= F.col("target_date")))).cast("long")
    p = p.withColumn("aopen", adjust.adjusted(F.col("open"), F.col("date"), F.col("target_date"), F.col("events"))).withColumn("aclose", adjust.adjusted(F.col("close"), F.col("date"), F.col("target_date"), F.col("events"))).withColumn("crossings", crossing)
    ends = p.groupBy("signal_id").agg((F.max(F.when(F.col("step") == 9, F.col("aclose"))) / F.max(F.when(F.col("step") == 0, F.col("aopen"))) * 100 - 100).alias("r"), F.max("crossings").alias("crossings"))
    return ends.select("signal_id", F.round("r", 6).alias("return_pct"), "crossings")


@query(
    "o2_5_signal_schedule",
    f"WITH {B}, {P.SESSIONS} SELECT max(date) AS signal_date, 'QUARTER_END' AS kind FROM sessions GROUP BY year(date), quarter(date) UNION ALL SELECT max(date), 'LATEST' FROM sessions",
)
def signal_schedule(spark, d):
    s = P.bars(spark, d).select("date").distinct()
    quarters = s.groupBy(F.year("date"), F.quarter("date")).agg(F.max("date").alias("signal_date")).select("signal_date", F.lit("QUARTER_END").alias("kind"))
    return quarters.unionByName(s.agg(F.max("date").alias("signal_date")).withColumn("kind", F.lit("LATEST")))


@query("o2_6_coverage_by_date", f"WITH {B}, {P.NUMBERED} SELECT date, count(*) AS raw_symbols, count(*) FILTER (rn >= 120) AS evaluable_symbols FROM nb GROUP BY 1")
def coverage_by_date(spark, d):
    return P.numbered(P.bars(spark, d)).groupBy("date").agg(F.count(F.lit(1)).alias("raw_symbols"), F.count_if(F.col("rn") >= 120).alias("evaluable_symbols"))


@query("o2_7_index_change", f"WITH {B}, {P.INDEX} SELECT date, round((close / nullif(lag(close, 5) OVER (ORDER BY date), 0) - 1) * 100, 6) AS index_chg5 FROM idx")
def index_change(spark, d):
    return fx.index_change(P.index_bars(P.bars(spark, d))).select("date", F.round("index_chg5", 6).alias("index_chg5"))


@query(
    "o2_8_timing_audit",
    f"WITH {B}, {P.NUMBERED}, {P.SIGNALS}, {P.SESSIONS}, x AS (SELECT signal_id, s.pos, lead(s.date) OVER (ORDER BY s.date) AS nxt FROM sessions s LEFT JOIN sig ON sig.signal_date = s.date), y AS (SELECT sig.signal_id, sig.signal_date, t.date AS next_session FROM sig JOIN sessions a ON a.date = sig.signal_date LEFT JOIN sessions t ON t.pos = a.pos + 1), "
    "z AS (SELECT y.*, min(b.date) AS execution_date FROM y LEFT JOIN bars b ON b.symbol = split_part(y.signal_id, ':', 1) AND b.date > y.signal_date GROUP BY 1, 2, 3) SELECT signal_id, next_session, execution_date, CASE WHEN execution_date IS NULL THEN 'NO_LATER_BAR' WHEN execution_date = next_session THEN 'NEXT_SESSION' ELSE 'LATER_SESSION' END AS status FROM z",
)
def timing_audit(spark, d):
    panel = P.bars(spark, d)
    ahead = panel.select("symbol", F.col("date").alias("signal_date"), F.lead("date").over(fx.by_symbol()).alias("execution_date"))
    s = P.sessions(panel).select(F.col("date").alias("signal_date"), F.lead("date").over(Window.orderBy("date")).alias("next_session"))
    x = P.signals(panel).join(ahead, ["symbol", "signal_date"]).join(F.broadcast(s), "signal_date")
    status = F.when(F.col("execution_date").isNull(), "NO_LATER_BAR").when(F.col("execution_date") == F.col("next_session"), "NEXT_SESSION").otherwise("LATER_SESSION")
    return x.select("signal_id", "next_session", "execution_date", status.alias("status"))


@query("o2_9_board_universe", f"WITH {B} SELECT date, symbol, round(volume, 6) AS volume FROM bars WHERE date = (SELECT max(date) FROM bars WHERE date <= DATE '1998-06-30') AND (symbol LIKE '60%' OR symbol LIKE '00%')")
def board_universe(spark, d):
    panel = P.bars(spark, d)
    last = panel.where("date <= DATE '1998-06-30'").agg(F.max("date").alias("date"))
    return panel.join(F.broadcast(last), "date").where("symbol LIKE '60%' OR symbol LIKE '00%'").select("date", "symbol", F.round("volume", 6).alias("volume"))
