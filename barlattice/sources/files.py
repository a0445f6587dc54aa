"""Readers, checks and sinks for the file formats of the model. Every rejected row carries its reason."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .panel import shared_folder

QUOTE_FIELDS = 50
STAMP_AT = 30


@dataclass(frozen=True)
class TablePaths:
    """Where the tables of a root are; nothing is probed."""

    root: str

    @classmethod
    def resolve(cls, environment: dict[str, str], default: str, variable: str = "BARLATTICE_DATA_ROOT") -> TablePaths:
        """The root that the environment names, else the default; an empty name is an error, not a default."""
        root = environment.get(variable, default)
        if not root.strip():
            raise ValueError(f"{variable} is empty")
        return cls(root.rstrip("/"))

    def table(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """A raw bar file (thscode, date_ms, *_price, volume, turnover) as bars; only these columns are read."""
    raw = spark.read.parquet(path).select("thscode", "date_ms", "open_price", "high_price", "low_price", "close_price", "volume", "turnover")
    date = F.to_date(F.from_utc_timestamp(F.timestamp_millis("date_ms"), "Asia/Shanghai"))
    return raw.select(F.col("thscode").alias("symbol"), date.alias("date"), *[F.col(f"{p}_price").alias(p) for p in ("open", "high", "low", "close")], "volume", "turnover")


def audit_bars(panel: DataFrame) -> DataFrame:
    """One row of integrity counts; keys are counted per symbol first, so that no task sees all of them."""
    per = panel.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("k"), F.count_if(F.col("close").isNull() | F.col("open").isNull()).alias("nulls"),
        F.count_if(F.least("open", "high", "low", "close") <= 0).alias("bad"), F.count_if(F.col("volume") < 0).alias("badv"),
        F.count_if((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))).alias("badb"), F.min("date").alias("a"), F.max("date").alias("z"),
    )
    return per.agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_symbols"), F.sum(F.col("n") - F.col("k")).alias("duplicate_keys"), F.sum("nulls").alias("null_prices"),
        F.sum("bad").alias("bad_prices"), F.sum("badv").alias("bad_volume"), F.sum("badb").alias("bad_bounds"), F.min("a").alias("first_date"), F.max("z").alias("last_date"),
    )


INDEX_SCHEMA = "code int, data struct<item array<struct<date date, close double, volume double>>>"


def index_from_payloads(payloads: DataFrame) -> DataFrame:
    """Index bars of all payloads (column ``payload``); a non-zero code or a date in two payloads ends the query."""
    doc = payloads.select(F.from_json("payload", INDEX_SCHEMA).alias("p"))
    bad = F.when(F.col("p").isNull() | (F.col("p.code") != 0), F.raise_error(F.lit("index payload with an error code"))).otherwise(F.lit(True))
    rows = doc.where(bad).select(F.explode("p.data.item").alias("i")).select("i.*")
    once = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.first("close").alias("close"), F.first("volume").alias("volume"))
    return once.where(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("index date twice: "), F.col("date").cast("string")))).otherwise(F.lit(True))).drop("n")


def parse_quotes(lines: DataFrame) -> DataFrame:
    """code, price, quote_date, status of each ``~``-delimited line in column ``value``."""
    body = F.regexp_extract("value", '="?([^"]*)"?', 1)
    x = lines.select(F.split(body, "~").alias("x"))
    few = F.size("x") < QUOTE_FIELDS
    price = F.get("x", F.lit(3)).try_cast("double")
    day = F.try_to_date(F.substring(F.get("x", F.lit(STAMP_AT)), 1, 8), "yyyyMMdd") if hasattr(F, "try_to_date") else F.to_date(F.substring(F.get("x", F.lit(STAMP_AT)), 1, 8), "yyyyMMdd")
    x = x.select(F.get("x", F.lit(2)).alias("code"), F.when(~few, price).alias("price"), F.when(~few, day).alias("day"), few.alias("few"))
    status = F.when(F.col("few"), "TOO_FEW_FIELDS").when(F.col("price").isNull(), "BAD_PRICE").when(F.col("day").isNull(), "BAD_TIMESTAMP").otherwise("OK")
    return x.select("code", "price", F.when(status == "OK", F.col("day")).alias("quote_date"), status.alias("status"))


WATCHLIST_SCHEMA = "date date, candidates array<struct<code string, trigger double, stop double, target double>>"


def watchlists(docs: DataFrame) -> DataFrame:
    """signal_date, n_candidates, status of documents (file, payload): the file's name must carry the payload's date."""
    x = docs.select(F.to_date(F.regexp_extract("file", r"watchlist_(\d{8})\.json$", 1), "yyyyMMdd").alias("named"), F.from_json("payload", WATCHLIST_SCHEMA).alias("p"))
    return x.select(F.col("p.date").alias("signal_date"), F.size("p.candidates").cast("long").alias("n_candidates"), F.when(F.col("named") == F.col("p.date"), "OK").otherwise("DATE_MISMATCH").alias("status"))


def content_hash(lines: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 over the sorted lines of each key; the key bounds what one row holds."""
    return lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("content_sha256"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the session's shared checkpoint folder, for files that are read again."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_canonical(df: DataFrame, path: str, order: list[str]) -> None:
    """Parquet (zstd) in ranges of the order, sorted within."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """CSV with a header and just these fields, in this order."""
    df.select(*fields).write.mode("errorifexists").option("header", True).csv(path)


def merge_parts(spark: SparkSession, parts: list[str], path: str, key: list[str], column: str) -> None:
    """One result of parts that share no key; a key in two parts is an error."""
    whole = spark.read.parquet(parts[0])
    for part in parts[1:]:
        whole = whole.unionByName(spark.read.parquet(part))
    twice = whole.groupBy(*key).count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError("parts overlap")
    write_by_date(whole, path, column)


def write_lines(df: DataFrame, path: str) -> None:
    """Compressed JSON lines; the session's default codec settings make equal rows equal bytes."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def write_streams(df: DataFrame, path: str, stream: str, order: list[str], line: str | Column, rows: int = 1_000_000) -> None:
    """The lines of each stream in order, as gzip text files of ``rows`` lines; equal rows make equal bytes, however they lie.

    Each file is one stretch of its stream's places, sorted within its task, so a long stream is many files. Rows are
    exchanged once, straight to their file; ``df`` is read several times. Rows that tie in the order lie by their line.
    With an expression for ``line`` all columns of ``df`` are exchanged and the lines, often longer, made of them after that.
    """
    from barlattice.operators.statistics import group_stretches

    order = [c for c in dict.fromkeys(order) if c != stream]
    if isinstance(line, str):
        df, line = df.select(*dict.fromkeys([stream, *order, line])), F.col(line)
    text = F.coalesce(line, F.lit("")).alias("__line")
    x = group_stretches(df.select("*", text), stream, [*order, "__line"], rows, "__file").drop("__line")
    x = x.repartition(stream, "__file").select("*", text).sortWithinPartitions(stream, "__file", *order, "__line")
    x.select(F.col(stream), F.col("__file").alias("stretch"), F.col("__line").alias("value")).write.partitionBy(stream, "stretch").option("compression", "gzip").text(path)


def file_hashes(spark: SparkSession, path: str, stream: str) -> DataFrame:
    """Per stream of ``write_streams``: n_files, n_bytes and files_sha256, the hash of its files' hashes; bytes are hashed where they are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").load(path)
    place = [F.regexp_extract("path", f"/{n}=([^/]*)/", 1) for n in (stream, "stretch")]
    x = raw.select(F.url_decode(place[0]).alias(stream), place[1].cast("long").alias("stretch"), "length", F.sha2("content", 256).alias("sha256"))
    g = x.groupBy(stream).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"), F.sort_array(F.collect_list(F.struct("stretch", "sha256"))).alias("all"))
    return g.select(stream, "n_files", "n_bytes", F.sha2(F.array_join(F.transform("all", lambda r: r["sha256"]), ""), 256).alias("files_sha256"))


def write_by_date(df: DataFrame, path: str, column: str = "signal_date") -> None:
    """Parquet by date; a rerun replaces only the dates that it holds."""
    df.repartition(column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def duplicate_status(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows per key, and whether repeated keys repeat the same values (collapse) or conflict."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.struct(*values)).alias("a"), F.max(F.struct(*values)).alias("z"))
    status = F.when(F.col("n_rows") == 1, "UNIQUE").when(F.col("a") == F.col("z"), "EXACT_DUPLICATE").otherwise("CONFLICT")
    return n.select(*keys, "n_rows", status.alias("status"))


def audit_values(rows: DataFrame) -> DataFrame:
    """Per trade_date: rows, and blank, non-numeric and negative values of the text column ``value``."""
    number = F.col("value").try_cast("double")
    return rows.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value") == "").alias("n_blank"), F.count_if((F.col("value") != "") & number.isNull()).alias("n_non_numeric"), F.count_if(number < 0).alias("n_negative"))


def normalise_records(raw: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Fields by the first alias that is not null; rows that cannot be used keep the reason."""
    x = raw.select(*[F.coalesce(*names).alias(field) for field, names in aliases.items()])
    reason = F.when(F.col("name").isNull(), "MISSING_NAME").when(F.col("price").isNull(), "MISSING_PRICE").when(F.col("price") <= 0, "NON_POSITIVE_PRICE")
    return x.withColumn("excluded_reason", reason)
