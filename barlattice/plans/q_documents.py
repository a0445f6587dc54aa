"""Queries over files that are written and read again: index, quotes, watchlists (o1.2, o1.4, o1.5), evidence (o10.14)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlattice.sources import documents as dc
from barlattice.sources import evidence as ev
from barlattice.sources import files
from barlattice.sources import panel as P

from .registry import query

B = P.BARS

INDEX_YEARS = f"{B}, {P.INDEX}, ix AS (SELECT date, year(date) AS y, round(close, 4) AS close, round(volume, 2) AS volume FROM idx), lastday AS (SELECT y, max(date) AS z FROM ix GROUP BY 1)"


def written_index(spark, d):
    """The glob of yearly index files: years by 7: 1 has an error code, 2 is cut off, 3 is empty, 4 has its last date in another file too."""
    x = P.index_bars(P.bars(spark, d)).select("date", F.year("date").alias("y"), F.round("close", 4).alias("close"), F.round("volume", 2).alias("volume"))
    at = F.unix_millis(F.to_utc_timestamp(F.col("date").cast("timestamp"), "Asia/Shanghai"))
    item = F.struct(at.alias("date_ms"), *[F.col("close").alias(f"{p}_price") for p in ("open", "high", "low", "close")], "volume")
    years = x.groupBy("y").agg(F.sort_array(F.collect_list(item)).alias("item")).withColumn("fault", F.col("y") % 7)
    more = years.where("fault = 4").select((F.col("y") + 1000).alias("y"), F.slice("item", F.size("item"), 1).alias("item"), F.lit(0).alias("fault"))
    docs = years.unionByName(more)
    document = F.to_json(F.struct(F.when(F.col("fault") == 1, 500).otherwise(0).alias("code"), F.struct(F.when(F.col("fault") == 3, F.array().cast("array<struct<date_ms:bigint,open_price:double,high_price:double,low_price:double,close_price:double,volume:double>>")).otherwise(F.col("item")).alias("item")).alias("data")))
    content = F.when(F.col("fault") == 2, F.expr("substring(document, 1, length(document) - 9)")).otherwise(F.col("document"))
    docs = docs.withColumn("document", document).select(F.concat(F.lit("index_"), F.col("y").cast("string"), F.lit(".json")).alias("name"), content.alias("content"))
    path = files.scratch(spark, "index")
    dc.write_documents(docs, path, "name", "content")
    return f"{path}/index_*.json"


@query(
    "o1_2b_index_files",
    f"WITH {INDEX_YEARS} SELECT ix.date, ix.close, ix.volume, 'index_' || ix.y || '.json' AS file FROM ix JOIN lastday l USING (y) WHERE ix.y % 7 NOT IN (1, 2, 3) AND NOT (ix.y % 7 = 4 AND ix.date = l.z)",
)
def index_files(spark, d):
    bars, _ = dc.index_files(spark, written_index(spark, d))
    return bars.select("date", "close", "volume", "file")


@query(
    "o1_2c_index_rejects",
    f"WITH {INDEX_YEARS} SELECT 'index_' || y || '.json' AS file, CAST(NULL AS DATE) AS date, CASE y % 7 WHEN 1 THEN 'ERROR_CODE' WHEN 2 THEN 'BROKEN_JSON' ELSE 'NO_ITEMS' END AS reason FROM lastday WHERE y % 7 IN (1, 2, 3) "
    "UNION ALL SELECT 'index_' || (y + v.n) || '.json', z, 'DATE_TWICE' FROM lastday, (VALUES (0), (1000)) v(n) WHERE y % 7 = 4",
)
def index_rejects(spark, d):
    return dc.index_files(spark, written_index(spark, d))[1]


MONTHLY = f"{B}, nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM bars), mo AS (SELECT *, strftime(date, '%Y%m') AS month FROM nb WHERE pc IS NOT NULL)"
QUOTE_REASON = "CASE WHEN rn % 11 = 3 THEN 'BAD_SYMBOL' WHEN rn % 13 = 3 THEN 'TOO_FEW_FIELDS' WHEN rn % 17 = 3 THEN 'CODE_MISMATCH' WHEN rn % 19 = 3 THEN 'BAD_TIMESTAMP' WHEN rn % 23 = 3 THEN 'BAD_PRICE' WHEN rn % 29 = 3 THEN 'NOT_POSITIVE' END"


def written_quotes(spark, d):
    """The glob of quote responses, one a month, ended by semicolons and some by line ends; every other month's lines with both."""
    w = Window.partitionBy("symbol").orderBy("date")
    x = P.bars(spark, d).select("symbol", "date", "close", F.row_number().over(w).alias("rn"), F.lag("close").over(w).alias("pc")).where("pc IS NOT NULL")
    code = F.substring("symbol", 3, 6)
    price = F.round("close", 4).cast("string")
    faulty = {n: F.col("rn") % n == 3 for n in (11, 13, 17, 19, 23, 29)}
    fields = [F.lit("0")] * 53
    fields[1], fields[2] = F.col("symbol"), F.when(faulty[17] & ~faulty[11] & ~faulty[13], F.lit("000000x")).otherwise(code)
    fields[3] = F.when(faulty[23], "n/a").otherwise(price)
    fields[4] = F.when(faulty[29], "0").otherwise(F.round("pc", 4).cast("string"))
    for i in (5, 33, 34):
        fields[i] = price
    fields[30] = F.concat(F.date_format("date", "yyyyMMdd"), F.when(faulty[19], "15").otherwise("150000"))
    whole = F.concat_ws("~", *fields)
    body = F.when(faulty[13], F.concat_ws("~", *fields[:40])).otherwise(whole)
    line = F.concat(F.lit("v_"), F.when(faulty[11], "xx").otherwise("sh"), code, F.lit('="'), body, F.lit('";'))
    month = F.date_format("date", "yyyyMM")
    lines = x.select(F.concat(F.lit("quotes_"), month, F.lit(".txt")).alias("name"), F.when(F.month("date") % 2 == 0, F.concat(line, F.lit("\r"))).otherwise(line).alias("value"))
    path = files.scratch(spark, "quotes")
    lines.withColumn("month", F.col("name")).repartition("month").select("month", "value").write.partitionBy("month").text(path)
    return f"{path}/month=*/*"


@query("o1_4b_quote_files", f"WITH {MONTHLY}, q AS (SELECT *, {QUOTE_REASON} AS reason FROM mo) SELECT substr(symbol, 3, 6) AS code, date AS quote_date, round(close, 4) AS price, round(pc, 4) AS prev_close FROM q WHERE reason IS NULL")
def quote_files(spark, d):
    return dc.quote_files(spark, written_quotes(spark, d))[0].select("code", "quote_date", "price", "prev_close")


@query("o1_4c_quote_rejects", f"WITH {MONTHLY}, q AS (SELECT *, {QUOTE_REASON} AS reason FROM mo) SELECT reason, count(*) AS n_lines FROM q WHERE reason IS NOT NULL GROUP BY 1")
def quote_rejects(spark, d):
    return dc.quote_files(spark, written_quotes(spark, d))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n_lines"))


WATCH = f"{B}, {P.NUMBERED}, {P.SIGNALS}, wl AS (SELECT signal_date, dayofyear(signal_date) AS k FROM sig GROUP BY 1, 2)"


def written_watchlists(spark, d):
    """The glob of one document for each signal date; by the day of the year some have another date's name, no date's name, are cut off or have no date."""
    s = P.signals(P.bars(spark, d)).select("signal_date", F.struct(F.substring("symbol", 3, 6).alias("code"), "trigger", "stop", "target").alias("c"), F.dayofyear("signal_date").alias("k"))
    docs = s.groupBy("signal_date", "k").agg(F.sort_array(F.collect_list("c")).alias("candidates"))
    document = F.to_json(F.struct(F.when(F.col("k") % 13 == 1, "soon").otherwise(F.col("signal_date").cast("string")).alias("date"), F.lit("close").alias("mode"), "candidates"))
    own = F.date_format("signal_date", "yyyyMMdd")
    token = F.when(F.col("k") % 7 == 1, F.concat(F.lit("2"), own)).when(F.col("k") % 11 == 1, F.concat(F.date_format("signal_date", "yyyy"), F.lit("1399"))).otherwise(own)
    name = F.concat(F.lit("watchlist_"), token, F.when(F.col("k") % 17 == 1, F.lit("_old")).otherwise(F.lit("")), F.lit(".json"))
    docs = docs.withColumn("document", document)
    # Two documents cannot have one name: of those whose name is no date, each year keeps one.
    docs = docs.select(name.alias("name"), F.when(F.col("k") % 19 == 1, F.expr("substring(document, 1, length(document) - 3)")).otherwise(F.col("document")).alias("content"))
    docs = docs.groupBy("name").agg(F.min("content").alias("content"))
    path = files.scratch(spark, "watchlists")
    dc.write_documents(docs, path, "name", "content")
    return f"{path}/*.json"


TOKEN = "CASE WHEN k % 7 = 1 THEN '2' || strftime(signal_date, '%Y%m%d') WHEN k % 11 = 1 THEN strftime(signal_date, '%Y') || '1399' ELSE strftime(signal_date, '%Y%m%d') END"
WATCH_REASON = "CASE WHEN k % 7 = 1 OR k % 17 = 1 THEN 'BAD_FILE_NAME' WHEN k % 11 = 1 THEN 'BAD_FILE_DATE' WHEN k % 19 = 1 THEN 'BROKEN_JSON' WHEN k % 13 = 1 THEN 'BAD_DATE' END"


@query(
    "o1_5b_watchlist_files",
    f"WITH {WATCH} SELECT 'watchlist_' || strftime(signal_date, '%Y%m%d') || '.json' AS file, signal_date AS date, substr(symbol, 3, 6) AS code, trigger, stop, target FROM sig JOIN wl USING (signal_date) WHERE {WATCH_REASON} IS NULL",
)
def watchlist_files(spark, d):
    return dc.watchlist_files(spark, written_watchlists(spark, d))[0]


@query("o1_5c_watchlist_rejects", f"WITH {WATCH}, r AS (SELECT 'watchlist_' || {TOKEN} || CASE WHEN k % 17 = 1 THEN '_old' ELSE '' END || '.json' AS file, {WATCH_REASON} AS reason FROM wl) SELECT DISTINCT file, reason FROM r WHERE reason IS NOT NULL")
def watchlist_rejects(spark, d):
    return dc.watchlist_files(spark, written_watchlists(spark, d))[1]


# Evidence ------------------------------------------------------------------------------------------

MONTH_ENDS = f"{B}, {P.SESSIONS}, me AS (SELECT max(date) AS date, CAST(strftime(date, '%Y%m') AS INTEGER) AS month FROM sessions GROUP BY 2), ms AS (SELECT *, row_number() OVER (ORDER BY month) AS m FROM me)"
# The fault of month m by m % 13, and what the audit must say of it.
FAULTS = {1: "file_sha256", 2: "raw_missing", 3: "sidecar_missing", 4: "unknown_component", 5: "retrieved_before_session_close", 6: "byte_length", 7: "retrieved_date", 8: "sidecar_unreadable", 9: "target_date", 10: "formal_provider_source", 11: "completeness_status"}
ERROR_SQL = "CASE m % 13 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in FAULTS.items()) + " ELSE '' END"
VERSION = "v1"


def month_ends(panel):
    x = P.sessions(panel).groupBy(F.date_format("date", "yyyyMM").cast("int").alias("month")).agg(F.max("date").alias("date"))
    return x.withColumn("m", F.row_number().over(Window.orderBy("month")) % 13)  # one row a month


def written_evidence(spark, panel):
    """The root of a raw file and a sidecar for each month's last session, with the fault of the month in the bytes or in what is said of them."""
    ends = month_ends(panel)
    lines = panel.join(F.broadcast(ends), "date").select("date", "m", F.concat_ws("~", "symbol", F.round("close", 4).cast("string")).alias("line"))
    raw = lines.groupBy("date", "m").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("text"), F.count(F.lit(1)).alias("n"))
    ending = F.concat("text", F.lit("\n"))  # as a text file is written
    day = F.col("date").cast("string")
    at = F.when(F.col("m") == 5, F.concat(day, F.lit("T14:59:00+08:00"))).when(F.col("m") == 7, F.concat(F.date_add("date", 1).cast("string"), F.lit("T15:30:00+08:00"))).otherwise(F.concat(day, F.lit("T15:30:00+08:00")))
    said = F.to_json(F.struct(
        F.lit(ev.CAPTURE_SCHEMA).alias("schema_version"), F.when(F.col("m") == 9, "1970-01-01").otherwise(day).alias("target_date"), day.alias("effective_trading_date"), F.lit(VERSION).alias("code_version"),
        F.when(F.col("m") == 11, "PARTIAL").otherwise("COMPLETE").alias("completeness_status"), F.lit("quotes").alias("provider"), F.when(F.col("m") == 10, "elsewhere").otherwise("quote-service").alias("source_identity"),
        F.sha2(ending, 256).alias("file_sha256"), (F.octet_length(ending) + F.when(F.col("m") == 6, 1).otherwise(0)).alias("byte_length"), at.alias("retrieved_at"), F.col("n").alias("record_count"),
    ))
    where = F.concat(F.when(F.col("m") == 4, "rumour").otherwise("quote"), F.lit("/"), day)
    spoilt = F.when(F.col("m") == 1, F.concat(F.expr("substring(text, 1, length(text) - 1)"), F.lit("?"))).otherwise(F.col("text"))
    sidecar = F.when(F.col("m") == 8, F.expr("substring(said, 1, length(said) - 4)")).otherwise(F.col("said"))
    raw = P.kept(raw.withColumn("said", said))
    docs = raw.where("m <> 2").select(F.concat(where, F.lit(".raw")).alias("name"), spoilt.alias("content")).unionByName(raw.where("m <> 3").select(F.concat(where, F.lit(".json")).alias("name"), sidecar.alias("content")))
    path = files.scratch(spark, "evidence")
    dc.write_documents(docs, path, "name", "content")
    return path


def audited(spark, panel):
    found = ev.captures(spark, written_evidence(spark, panel)).withColumn("date", F.col("capture").cast("date"))
    closes = F.to_utc_timestamp(F.concat(F.col("capture"), F.lit(" 15:00:00")).cast("timestamp"), "Asia/Shanghai")
    return P.kept(ev.audit(found.withColumn("closes", closes), "date", "closes", VERSION))


@query(
    "o10_14c_evidence_audit",
    f"WITH {MONTH_ENDS} SELECT date, CASE WHEN m % 13 = 4 THEN 'rumour' ELSE 'quote' END AS component, {ERROR_SQL} AS errors FROM ms",
)
def evidence_audit(spark, d):
    """What the files of each month-end review say against themselves."""
    return audited(spark, P.kept_bars(spark, d)).select("date", "component", F.concat_ws("|", "errors").alias("errors"))


@query(
    "o10_14d_recovered_reviews",
    f"WITH {MONTH_ENDS}, {P.NUMBERED}, {P.SIGNALS}, du AS (SELECT signal_id, symbol, sig.close AS known, ms.date AS due_date, m FROM sig JOIN ms ON ms.month = CAST(strftime(signal_date, '%Y%m') AS INTEGER)), "
    "x AS (SELECT du.*, CASE WHEN m % 13 BETWEEN 1 AND 11 THEN NULL ELSE round(b.close, 4) END AS price, m % 13 BETWEEN 1 AND 11 AS bad FROM du LEFT JOIN bars b ON b.symbol = du.symbol AND b.date = du.due_date) "
    "SELECT signal_id, due_date, CASE WHEN bad THEN 'EVIDENCE_REJECTED' WHEN price IS NULL THEN 'NOT_IN_EVIDENCE' WHEN abs(price / known - 1) > 0.2 THEN 'PRICE_BASIS_INCOMPATIBLE' ELSE 'RECOVERED' END AS status, CASE WHEN NOT bad AND abs(price / known - 1) <= 0.2 THEN price END AS price FROM x",
)
def recovered_reviews(spark, d):
    """Each signal's month-end review: its price comes from clean evidence of just that date or not at all."""
    panel = P.kept_bars(spark, d)
    found = audited(spark, panel)
    clean = ev.quotes(found).select(F.col("capture").cast("date").alias("due_date"), "symbol", "price")
    usable = found.where("size(errors) = 0").select(F.col("date").alias("due_date"), F.lit(True).alias("usable"))
    due = P.signals(panel).select("signal_id", "symbol", F.col("close").alias("known"), F.date_format("signal_date", "yyyyMM").cast("int").alias("month"))
    due = due.join(F.broadcast(month_ends(panel).select("month", F.col("date").alias("due_date"))), "month")
    x = due.join(F.broadcast(usable), "due_date", "left").join(clean, ["due_date", "symbol"], "left")
    far = F.abs(F.col("price") / F.col("known") - 1) > 0.2
    status = F.when(F.col("usable").isNull(), "EVIDENCE_REJECTED").when(F.col("price").isNull(), "NOT_IN_EVIDENCE").when(far, "PRICE_BASIS_INCOMPATIBLE").otherwise("RECOVERED")
    x = x.withColumn("status", status)
    return x.select("signal_id", "due_date", "status", F.when(F.col("status") == "RECOVERED", F.col("price")).alias("price"))
