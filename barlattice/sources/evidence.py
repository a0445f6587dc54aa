"""Captured evidence: raw files beside sidecars that describe them, audited by the bytes that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The schema of a capture, the components and the sources each may come from.
CAPTURE_SCHEMA = "T_CLOSE_SOURCE_CAPTURE_V1"
SOURCES = {"quote": [("quotes", "quote-service")], "kline": [("prices", "/prices/historical")], "sector": [("sectors", "sector-spot"), ("sectors", "sector-membership")]}

SIDECAR = (
    "schema_version string, target_date string, effective_trading_date string, code_version string, completeness_status string, provider string, source_identity string, "
    "file_sha256 string, byte_length long, retrieved_at string, record_count long"
)


def captures(spark: SparkSession, root: str) -> DataFrame:
    """component, capture, sidecar (its text, null where it is missing), raw (its bytes), their digest and length.

    Files are ``root/<component>/<capture>.json`` and ``.raw``; every file of either kind is in one row. Bytes are read and
    hashed where they lie.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)

    def side(kind: str) -> DataFrame:
        x = read.option("pathGlobFilter", f"*.{kind}").load(root)
        place = r"([^/]+)/([^/]+)\." + kind + "$"
        return x.select(F.url_decode(F.regexp_extract("path", place, 1)).alias("component"), F.url_decode(F.regexp_extract("path", place, 2)).alias("capture"), "content", "length")

    text = side("json").select("component", "capture", F.try_validate_utf8(F.col("content")).alias("sidecar"), F.lit(True).alias("has_sidecar"))
    raw = side("raw").select("component", "capture", F.col("content").alias("raw"), F.sha2("content", 256).alias("digest"), F.col("length").alias("raw_bytes"))
    return text.join(raw, ["component", "capture"], "full")


def audit(found: DataFrame, target: str, closes: str, code_version: str) -> DataFrame:
    """Adds the sidecar's fields and ``errors``, all that is wrong with each pair; a pair without errors is evidence.

    ``target`` and ``closes`` are columns: the date that the capture is for, and the time at which its session closed.
    Evidence must be complete, of a known component and source, of just these bytes, and retrieved on that date after the close.
    """
    meta = F.from_json("sidecar", SIDECAR + ", broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    x = found.withColumn("__m", meta)
    m = {c: F.col(f"__m.{c}") for c in [f.split(" ")[0] for f in SIDECAR.split(", ")]}
    readable = F.col("has_sidecar") & F.col("sidecar").isNotNull() & F.col("__m.broken").isNull() & F.col("__m").isNotNull()
    x = x.withColumn("__readable", F.coalesce(readable, F.lit(False)))
    day = F.col(target).cast("string")
    zoned = m["retrieved_at"].rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    at = m["retrieved_at"].try_cast("timestamp")
    known = F.col("component").isin(*SOURCES)
    pairs = [F.struct(F.lit(c).alias("c"), F.lit(p).alias("p"), F.lit(s).alias("s")) for c, own in SOURCES.items() for p, s in own]
    formal = F.array_contains(F.array(*pairs), F.struct(F.col("component").alias("c"), m["provider"].alias("p"), m["source_identity"].alias("s")))
    missing = F.col("raw_bytes").isNull()
    inside = [
        ("schema_version", ~m["schema_version"].eqNullSafe(F.lit(CAPTURE_SCHEMA))), ("target_date", ~m["target_date"].eqNullSafe(day)), ("effective_trading_date", m["effective_trading_date"] != day),
        ("code_version", ~m["code_version"].eqNullSafe(F.lit(code_version))), ("completeness_status", ~m["completeness_status"].eqNullSafe(F.lit("COMPLETE"))),
        ("provider_source_identity", F.coalesce(m["provider"], F.lit("")).eqNullSafe(F.lit("")) | F.coalesce(m["source_identity"], F.lit("")).eqNullSafe(F.lit(""))),
        ("formal_provider_source", known & m["provider"].isNotNull() & m["source_identity"].isNotNull() & ~formal),
        ("file_sha256", ~missing & ~m["file_sha256"].eqNullSafe(F.col("digest"))), ("byte_length", ~missing & ~m["byte_length"].eqNullSafe(F.col("raw_bytes"))),
        ("retrieved_at", at.isNull()), ("retrieved_timezone", at.isNotNull() & ~zoned), ("retrieved_before_session_close", zoned & (at < F.col(closes))),
        ("retrieved_date", zoned & (at >= F.col(closes)) & (F.substring(m["retrieved_at"], 1, 10) != day)),
    ]
    outside = [("sidecar_missing", F.col("has_sidecar").isNull()), ("sidecar_unreadable", F.col("has_sidecar") & ~F.col("__readable")), ("raw_missing", missing), ("unknown_component", ~known)]
    named = [F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in outside] + [F.when(F.col("__readable") & F.coalesce(bad, F.lit(False)), name) for name, bad in inside]
    return x.select("*", F.array_compact(F.array(*named)).alias("errors"), m["record_count"].alias("record_count")).drop("__m", "__readable")


def quotes(audited: DataFrame) -> DataFrame:
    """component, capture, symbol and price of the lines ``symbol~price`` of clean quote captures.

    A capture whose lines are not as many as its sidecar says, or name a symbol twice, gives none of them.
    """
    x = audited.where("component = 'quote' AND size(errors) = 0")
    lines = F.filter(F.split(F.try_validate_utf8(F.col("raw")), "\n"), lambda t: t != "")
    x = x.select("component", "capture", "record_count", F.transform(lines, lambda t: F.struct(F.split(t, "~")[0].alias("symbol"), F.split(t, "~")[1].try_cast("double").alias("price"))).alias("q"))
    once = F.size(F.array_distinct(F.transform("q", lambda r: r["symbol"]))) == F.size("q")
    return x.where((F.size("q") == F.col("record_count")) & once).select("component", "capture", F.explode("q").alias("q")).select("component", "capture", "q.symbol", "q.price")
