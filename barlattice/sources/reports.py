"""Dated research reports read back: manifest and page of each day, checked against each other before anything counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import first_reason
from .panel import kept

# The report's schema and rules, its states, and the patterns of its pages (now and in the first version).
SCHEMA_VERSION = "C_DAILY_RESEARCH_WATCHLIST_V1"
RULES = ["BALANCED_A", "CONSERVATIVE_B"]
WITH_MATCHES, NO_MATCH = "C_SUCCESS_WITH_MATCHES", "C_SUCCESS_NO_MATCH"
MATCHED = "PRICE_STRUCTURE_MATCH_VOLUME_GATE_UNVERIFIED"
NOT_MATCHED, LEGACY_MATCH, NOTHING_PENDING = "RULE_NOT_MATCHED", "价格结构研究匹配", "数据待核验 0"
CARD = r"""(?s)<article class=(?:"c-stock-card"|'card')>(.*?)</article>"""
SYMBOL, LEGACY_SYMBOL = r'<span class="c-stock-symbol">(\d{6})</span>', r"<h3>(\d{6}) "
BLOCK, LEGACY_BLOCK = r"(?s)<p><strong>{0}</strong> · 事件身份.*?(?=<p><strong>|<p>来源：|$)", r'(?s)<section class="rule"><h4>{0} .*?</section>'
TREND = r"趋势：([^；]+)；均线顺序 (True|False|—)；收盘高于快线 (True|False|—)；趋势合格 (True|False|—)"
STRUCTURE, CONFIRM, VERDICT = r"回踩：([^；]+)；", r"(?s)反弹确认：(True|False|—)；.*?支撑判定 (True|False|—)", r"判定 ([^；]+)；"

MANIFEST = "schema_version string, signal_date string, version_sha256 string, html_sha256 string, matched_stock_count long, matched_by_rule map<string,long>, c_status string, coverage_status string, broken string"


def rule_cards(cards: DataFrame) -> DataFrame:
    """day, at, symbol, rule, problem and the fields of each rule on each card (day, at, card); a flag of ``—`` is null.

    A card without a symbol, without a rule's block, or with a block that lacks a field keeps its problem and no fields.
    """
    now, old = F.regexp_extract("card", SYMBOL, 1), F.regexp_extract("card", LEGACY_SYMBOL, 1)
    x = cards.select("day", "at", "card", F.when(now != "", now).when(old != "", old).alias("symbol"), (now == "").alias("legacy"))
    parts = []
    for rule in RULES:
        block = F.when(F.col("legacy"), F.regexp_extract("card", LEGACY_BLOCK.format(rule), 0)).otherwise(F.regexp_extract("card", BLOCK.format(rule), 0))
        parts.append(F.struct(F.lit(rule).alias("rule"), block.alias("block")))
    x = x.select("day", "at", "symbol", "legacy", F.explode(F.array(*parts)).alias("r")).select("day", "at", "symbol", "legacy", "r.rule", "r.block")
    text = F.regexp_replace("block", "<[^>]+>", "")
    for code, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    x = x.withColumn("text", text)

    def got(pattern: str, nth: int) -> Column:
        return F.nullif(F.regexp_extract("text", pattern, nth), F.lit(""))

    def flag(pattern: str, nth: int) -> Column:
        return F.when(got(pattern, nth) == "True", True).when(got(pattern, nth) == "False", False)

    verdict = F.when(F.col("legacy"), F.when(F.col("text").contains(LEGACY_MATCH), MATCHED).otherwise(NOT_MATCHED)).otherwise(got(VERDICT, 1))
    lacks = got(TREND, 1).isNull() | got(STRUCTURE, 1).isNull() | got(CONFIRM, 1).isNull() | verdict.isNull()
    problem = first_reason([("UNRECOGNISED_CARD", F.col("symbol").isNull()), ("MISSING_RULE", F.col("block") == ""), ("INCOMPLETE_RULE", lacks)])
    fields = {
        "research_match_status": verdict, "trend_status": got(TREND, 1), "ma_order_ok": flag(TREND, 2), "close_above_fast_average": flag(TREND, 3), "trend_qualified": flag(TREND, 4),
        "structure_status": got(STRUCTURE, 1), "confirmation_qualified": flag(CONFIRM, 1), "entry_support_ok": flag(CONFIRM, 2),
    }
    x = x.withColumn("problem", problem)
    return x.select("day", "at", "symbol", "rule", "problem", *[F.when(F.col("problem").isNull(), v).alias(n) for n, v in fields.items()])


def read_reports(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(days, details) of the reports ``root/<YYYYMMDD>/{manifest.json,index.html}``, each also below its version's hash.

    days: day, signal_date, status, status_source, total, the number by each rule, coverage_status and reason. A day with a
    reason has no numbers at all, and neither has one whose status is no success: pending is not zero. details: one
    row for each card and rule of the days that hold. Any fault of a page or card refuses its whole day.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    x = raw.select(F.regexp_extract("path", r"/(\d{8})/(?:([^/]+)/)?(manifest\.json|index\.html)$", 1).alias("day"), F.regexp_extract("path", r"/(\d{8})/(?:([^/]+)/)?(manifest\.json|index\.html)$", 2).alias("version"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")
    x = x.where("day <> ''").withColumn("digest", F.sha2("content", 256))

    def one(name: str) -> DataFrame:
        here = (F.col("name") == name) & (F.col("version") == "")
        return x.where(here).select("day", F.try_validate_utf8(F.col("content")).alias(name.split(".")[0]), F.col("digest").alias(f"{name.split('.')[0]}_digest"))

    copies = x.where("version <> ''").groupBy("day").agg(F.collect_list(F.struct("version", "name", "digest")).alias("copies"))
    days = one("manifest.json").join(one("index.html"), "day", "full").join(copies, "day", "left")
    days = days.withColumn("m", F.from_json("manifest", MANIFEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))
    days = kept(days.select("day", "index", "manifest_digest", "index_digest", "copies", F.col("m").isNull().alias("none"), "m.*"))
    cards = days.select("day", F.posexplode(F.regexp_extract_all("index", F.lit(CARD), F.lit(1))).alias("at", "card"))
    rules = kept(rule_cards(cards))
    matched = F.col("research_match_status") == MATCHED
    seen = rules.groupBy("day").agg(
        F.min(F.when(F.col("problem").isNotNull(), F.struct("at", "rule", "problem"))).alias("worst"), F.count_distinct("at").alias("cards"), F.count_distinct("symbol").alias("symbols"),
        *[F.count_if(matched & (F.col("rule") == rule)).alias(f"seen_{rule}") for rule in RULES],
    )
    days = days.join(seen, "day", "left")
    by = {rule: F.col("matched_by_rule")[rule] for rule in RULES}
    total = F.col("matched_stock_count")
    counts_bad = total.isNull() | (total < 0)
    for v in by.values():
        counts_bad = counts_bad | v.isNull() | (v < 0)
    union_bad = (F.greatest(*by.values()) > total) | (total > sum(by.values(), F.lit(0)))
    proven = F.lit(True)
    for rule in RULES:
        proven = proven & F.col("index").contains(f"{rule} {NOTHING_PENDING}")
    status = F.coalesce("c_status", F.when(proven, F.when(total > 0, WITH_MATCHES).otherwise(NO_MATCH)))
    days = days.withColumn("status", status)

    def copied(name: str, digest: str) -> Column:
        return F.array_contains(F.coalesce("copies", F.array()), F.struct(F.col("version_sha256").alias("version"), F.lit(name).alias("name"), F.col(digest).alias("digest")))

    rule_bad = F.lit(False)
    for rule, v in by.items():
        rule_bad = rule_bad | (F.coalesce(F.col(f"seen_{rule}"), F.lit(0)) != v)
    reason = first_reason([
        ("NO_MANIFEST", F.col("manifest_digest").isNull()), ("NO_PAGE", F.col("index").isNull()), ("BROKEN_MANIFEST", F.col("none") | F.col("broken").isNotNull()), ("DATE_MISMATCH", ~F.replace("signal_date", F.lit("-"), F.lit("")).eqNullSafe(F.col("day"))),
        ("BAD_SCHEMA", ~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION))), ("BAD_VERSION", ~F.coalesce(F.col("version_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))),
        ("VERSION_MISMATCH", ~copied("manifest.json", "manifest_digest") | ~copied("index.html", "index_digest")), ("HASH_MISMATCH", ~F.col("html_sha256").eqNullSafe(F.col("index_digest"))),
        ("BAD_COUNTS", counts_bad), ("BAD_UNION", union_bad), ("NO_STATUS", F.col("status").isNull()), ("STATUS_MISMATCH", ((F.col("status") == NO_MATCH) & (total != 0)) | ((F.col("status") == WITH_MATCHES) & (total == 0))),
        ("CARD_PROBLEM", F.col("worst").isNotNull()), ("SYMBOL_TWICE", F.col("symbols") < F.col("cards")), ("CARD_COUNT_MISMATCH", F.coalesce("cards", F.lit(0)) != total), ("RULE_COUNT_MISMATCH", rule_bad),
    ])
    days = days.withColumn("reason", F.when(reason == "CARD_PROBLEM", F.col("worst.problem")).otherwise(reason))
    success = F.col("reason").isNull() & F.col("status").isin(WITH_MATCHES, NO_MATCH)
    holds = F.col("reason").isNull()
    out = kept(days.select(
        "day", F.when(holds, F.to_date("signal_date")).alias("signal_date"), F.when(holds, F.col("status")).alias("status"), F.when(holds, F.when(F.col("c_status").isNull(), "PAGE").otherwise("MANIFEST")).alias("status_source"),
        F.when(success, total).alias("total"), *[F.when(success, v).alias(rule.lower()) for rule, v in by.items()], F.when(holds, F.col("coverage_status")).alias("coverage_status"), "reason",
    ))
    return out, rules.join(out.where("reason IS NULL").select("day"), "day", "left_semi").drop("problem", "at")
