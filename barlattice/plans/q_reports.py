"""Queries over dated reports that are written and parsed back (o13.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.sources import documents as dc
from barlattice.sources import files
from barlattice.sources import panel as P
from barlattice.sources import reports as rp

from .q_documents import MONTH_ENDS, month_ends
from .registry import query

# The cards of a month-end report: the month's symbols with a signal whose first place in the month is even (rule A) or divisible by 3 (rule B).
CARDS = f"{MONTH_ENDS}, {P.NUMBERED}, {P.SIGNALS}, fs AS (SELECT CAST(strftime(signal_date, '%Y%m') AS INTEGER) AS month, symbol, min(rn) AS rn FROM sig GROUP BY 1, 2), cd AS (SELECT * FROM fs WHERE rn % 2 = 0 OR rn % 3 = 0), " \
    "dy AS (SELECT ms.date, strftime(ms.date, '%Y%m%d') AS day, ms.m % 13 AS m, count(symbol) AS n, count(*) FILTER (rn % 2 = 0) AS a, count(*) FILTER (rn % 3 = 0) AS b FROM ms LEFT JOIN cd USING (month) GROUP BY 1, 2, 3), " \
    "rs AS (SELECT *, CASE WHEN m = 1 THEN 'HASH_MISMATCH' WHEN m = 2 THEN 'VERSION_MISMATCH' WHEN m = 3 AND n + 1 > a + b THEN 'BAD_UNION' WHEN m = 3 THEN 'CARD_COUNT_MISMATCH' WHEN m = 4 AND n > 0 THEN 'STATUS_MISMATCH' WHEN m = 5 AND n > 0 THEN 'UNRECOGNISED_CARD' " \
    "WHEN m = 6 AND n > 0 THEN 'MISSING_RULE' WHEN m = 8 AND a > 0 AND n > a - 1 + b THEN 'BAD_UNION' WHEN m = 8 AND a > 0 THEN 'RULE_COUNT_MISMATCH' WHEN m = 9 THEN 'DATE_MISMATCH' WHEN m = 10 THEN 'BROKEN_MANIFEST' END AS reason FROM dy)"


def written_reports(spark, d):
    """The root of the month-end reports, each with the fault of its month in the page, the manifest or the copy."""
    panel = P.kept_bars(spark, d)
    ends = month_ends(panel)
    first = P.signals(panel).groupBy(F.date_format("signal_date", "yyyyMM").cast("int").alias("month"), "symbol").agg(F.min("rn").alias("rn")).where("rn % 2 = 0 OR rn % 3 = 0")

    def rule(name, hit):
        verdict = F.when(hit, rp.MATCHED).otherwise(rp.NOT_MATCHED)
        return F.concat(F.lit(f"<p><strong>{name}</strong> · 事件身份 x</p><p>判定 "), verdict, F.lit("；</p><p>趋势：OK；均线顺序 "), F.when(F.col("rn") % 5 == 0, "False").otherwise("True"), F.lit("；收盘高于快线 True；趋势合格 —。</p><p>回踩：浅 &amp; 短；深度。</p><p>反弹确认：True；支撑判定 False。</p>"))

    card = F.concat(F.lit('<article class="c-stock-card"><span class="c-stock-symbol">'), F.substring("symbol", 3, 6), F.lit("</span>"), rule("BALANCED_A", F.col("rn") % 2 == 0), rule("CONSERVATIVE_B", F.col("rn") % 3 == 0), F.lit("<p>来源：x</p></article>"))
    pages = first.groupBy("month").agg(F.array_join(F.sort_array(F.collect_list(card)), "").alias("cards"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("rn") % 2 == 0).alias("a"), F.count_if(F.col("rn") % 3 == 0).alias("b"))
    x = ends.join(pages, "month", "left").na.fill({"cards": "", "n": 0, "a": 0, "b": 0})
    m = F.col("m")
    broken = F.when(m == 5, F.regexp_replace("cards", r"c-stock-symbol\">(\d)", 'c-stock-symbol">x$1')).when(m == 6, F.regexp_replace("cards", "<strong>CONSERVATIVE_B</strong>", "<strong>OTHER</strong>")).otherwise(F.col("cards"))
    x = x.withColumn("page", F.concat(F.lit("<html>"), broken, F.lit("</html>"))).withColumn("day", F.date_format("date", "yyyyMMdd"))
    page_hash = F.sha2(F.concat("page", F.lit("\n")), 256)  # as a text file is written
    status = F.when(m == 7, "C_DATA_PENDING").when((m == 4) | (F.col("n") == 0), rp.NO_MATCH).otherwise(rp.WITH_MATCHES)
    said = F.to_json(F.struct(
        F.lit(rp.SCHEMA_VERSION).alias("schema_version"), F.when(m == 9, "1970-01-01").otherwise(F.col("date").cast("string")).alias("signal_date"), F.sha2("day", 256).alias("version_sha256"), F.when(m == 1, F.sha2("page", 256)).otherwise(page_hash).alias("html_sha256"),
        (F.col("n") + F.when(m == 3, 1).otherwise(0)).alias("matched_stock_count"), F.struct((F.col("a") - F.when((m == 8) & (F.col("a") > 0), 1).otherwise(0)).alias("BALANCED_A"), F.col("b").alias("CONSERVATIVE_B")).alias("matched_by_rule"), status.alias("c_status"), F.lit("FULL").alias("coverage_status"),
    ))
    x = x.withColumn("said", F.when(m == 10, F.substring(said, 1, 40)).otherwise(said))
    version = F.concat(F.col("day"), F.lit("/"), F.sha2("day", 256))
    parts = F.array(
        F.struct(F.concat("day", F.lit("/manifest.json")).alias("name"), F.col("said").alias("content")), F.struct(F.concat("day", F.lit("/index.html")).alias("name"), F.col("page").alias("content")),
        F.struct(F.concat(version, F.lit("/manifest.json")).alias("name"), F.col("said").alias("content")), F.struct(F.concat(version, F.lit("/index.html")).alias("name"), F.concat("page", F.when(m == 2, "x").otherwise("")).alias("content")),
    )
    path = files.scratch(spark, "reports")
    dc.write_documents(P.kept(x).select(F.explode(parts).alias("p")).select("p.*"), path, "name", "content")
    return path


@query(
    "o13_6b_report_days",
    f"WITH {CARDS} SELECT day, CASE WHEN reason IS NULL THEN CASE WHEN m = 7 THEN 'C_DATA_PENDING' WHEN n = 0 THEN 'C_SUCCESS_NO_MATCH' ELSE 'C_SUCCESS_WITH_MATCHES' END END AS status, CASE WHEN reason IS NULL AND m <> 7 THEN n END AS total, CASE WHEN reason IS NULL AND m <> 7 THEN a END AS balanced_a, CASE WHEN reason IS NULL AND m <> 7 THEN b END AS conservative_b, reason FROM rs",
)
def report_days(spark, d):
    """Each report with its numbers, or why it has none."""
    return rp.read_reports(spark, written_reports(spark, d))[0].select("day", "status", "total", "balanced_a", "conservative_b", "reason")


@query(
    "o13_6c_report_details",
    f"WITH {CARDS} SELECT day, substr(symbol, 3, 6) AS symbol, r.name AS rule, CASE WHEN rn % r.step = 0 THEN '{rp.MATCHED}' ELSE '{rp.NOT_MATCHED}' END AS research_match_status, rn % 5 <> 0 AS ma_order_ok, CAST(NULL AS BOOLEAN) AS trend_qualified, '浅 & 短' AS structure_status, FALSE AS entry_support_ok "
    "FROM rs JOIN cd ON cd.month = CAST(strftime(rs.date, '%Y%m') AS INTEGER), (VALUES ('BALANCED_A', 2), ('CONSERVATIVE_B', 3)) r(name, step) WHERE reason IS NULL",
)
def report_details(spark, d):
    """The cards of the reports that hold, rule by rule."""
    return rp.read_reports(spark, written_reports(spark, d))[1].select("day", "symbol", "rule", "research_match_status", "ma_order_ok", "trend_qualified", "structure_status", "entry_support_ok")
