"""Sources that are files: read by glob, with rows that are accepted and files or lines that are rejected, each with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file shown with its reason.
SHOWN = 200

INDEX_ITEM = "struct<date_ms: bigint, open_price: double, high_price: double, low_price: double, close_price: double, volume: double>"
INDEX_FILE = f"code int, data struct<item: array<{INDEX_ITEM}>>, broken string"
WATCHLIST_FILE = "date string, mode string, candidates array<struct<code: string, trigger: double, stop: double, target: double>>, broken string"


def json_files(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One row for each file: the document's fields, ``file`` (its name) and ``broken``, what could not be read as the schema says."""
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(glob)
    return raw.select("*", F.col("_metadata.file_name").alias("file"))


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that holds; a check that is null does not hold."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in checks], F.lit(None).cast("string"))


def index_files(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """(bars, rejected) of yearly index files: date, open, high, low, close, volume, file; and file, date, reason.

    A file that is no such JSON, has a code other than zero or no items is rejected whole; a date that several items
    have, in one file or in two, is rejected with each of its files, and has no bar.
    """
    docs = json_files(spark, glob, INDEX_FILE)
    item = F.col("data.item")
    docs = docs.withColumn("reason", first_reason([("BROKEN_JSON", F.col("broken").isNotNull()), ("ERROR_CODE", F.col("code").isNull() | (F.col("code") != 0)), ("NO_ITEMS", item.isNull() | (F.size(item) == 0))]))
    rejected = docs.where("reason IS NOT NULL").select("file", F.lit(None).cast("date").alias("date"), "reason")
    rows = docs.where("reason IS NULL").select("file", F.explode("data.item").alias("i")).select("file", "i.*")
    date = F.to_date(F.from_utc_timestamp(F.timestamp_millis("date_ms"), "Asia/Shanghai"))
    rows = rows.select("file", date.alias("date"), *[F.col(f"{p}_price").alias(p) for p in ("open", "high", "low", "close")], "volume")
    dateless = rows.where("date IS NULL").select("file", "date", F.lit("NO_DATE").alias("reason"))
    per = rows.where("date IS NOT NULL").groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("file")).alias("files"), F.first(F.struct("open", "high", "low", "close", "volume", "file")).alias("bar"))
    twice = per.where("n > 1").select(F.explode("files").alias("file"), "date", F.lit("DATE_TWICE").alias("reason"))
    return per.where("n = 1").select("date", "bar.*"), rejected.unionByName(twice).unionByName(dateless)


# Places of the fields of a quote, from 0, and the number a line has at least.
QUOTE_PLACES = {"price": 3, "prev_close": 4, "open": 5, "volume": 6, "chg_pct": 32, "high": 33, "low": 34, "turnover": 38, "vol_ratio": 49}
QUOTE_FIELDS, NAME_AT, CODE_AT, STAMP_AT = 50, 1, 2, 30


def quote_files(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """(quotes, rejected) of quote responses: code, symbol, name, the numbers, timestamp, quote_date, file; and file, line, reason.

    Files are read in pieces that end with ``;`` and cut further at line ends. A piece without ``=`` or ``~`` is no
    quote and ignored. Prices must be positive unless nothing was traded (the previous close, and zeros), numbers finite.
    """
    pieces = spark.read.option("lineSep", ";").text(glob).select("value", F.col("_metadata.file_name").alias("file"))
    lines = pieces.select("file", F.explode(F.split(F.regexp_replace("value", "\r", ""), "\n")).alias("line")).select("file", F.trim("line").alias("line"))
    lines = lines.where(F.col("line").contains("=") & F.col("line").contains("~"))
    symbol = F.lower(F.regexp_replace(F.trim(F.substring_index("line", "=", 1)), "^v_", ""))
    body = F.trim(F.expr("substring(line, locate('=', line) + 1)"))
    x = lines.select("file", "line", symbol.alias("symbol"), body.alias("body"))
    # A filter on the reason would move below and take all it is made of along, once for each use; none moves below an explode.
    x = x.select("*", F.explode(F.array(F.split(F.expr("substring(body, 2, length(body) - 2)"), "~"))).alias("x"))

    def field(place: int) -> Column:
        return F.trim(F.get("x", F.lit(place)))

    numbers = {n: field(p).try_cast("double") for n, p in QUOTE_PLACES.items()}
    stamp = field(STAMP_AT)
    told = F.struct(field(CODE_AT).alias("code"), field(NAME_AT).alias("name"), stamp.alias("timestamp"), F.try_to_timestamp(F.substring(stamp, 1, 8), F.lit("yyyyMMdd")).cast("date").alias("quote_date"), F.size("x").alias("n_fields"), *[v.alias(n) for n, v in numbers.items()])
    x = x.select("file", "line", "symbol", "body", F.explode(F.array(told)).alias("t")).select("file", "line", "symbol", "body", "t.*")
    bad_number = [(f"BAD_{n.upper()}", F.col(n).isNull() | F.isnan(n) | (F.abs(n) == float("inf"))) for n in QUOTE_PLACES]
    idle = (F.col("price") > 0) & (F.col("price") == F.col("prev_close"))
    for zero in ("chg_pct", "open", "high", "low", "volume", "turnover", "vol_ratio"):
        idle = idle & (F.col(zero) == 0)
    reason = first_reason([
        ("BAD_SYMBOL", ~F.col("symbol").rlike(r"^(sh|sz|bj)\d{6}$")), ("BAD_BODY", (F.length("body") < 2) | ~F.col("body").startswith('"') | ~F.col("body").endswith('"')), ("TOO_FEW_FIELDS", F.col("n_fields") < QUOTE_FIELDS),
        ("CODE_MISMATCH", F.col("code").isNull() | (F.col("code") != F.substring("symbol", 3, 6))), ("NO_NAME", F.col("name") == ""),
        ("BAD_TIMESTAMP", ~F.col("timestamp").rlike(r"^\d{14}$") | F.col("quote_date").isNull()), *bad_number,
        ("NOT_POSITIVE", ~idle & (F.least("price", "prev_close", "open") <= 0)), ("BAD_BOUNDS", ~idle & ((F.least("high", "low") <= 0) | (F.col("high") < F.col("low")))), ("NEGATIVE_RATIO", ~idle & (F.least("turnover", "vol_ratio") < 0)),
    ])
    x = x.select("*", F.explode(F.array(reason)).alias("reason"))
    quotes = x.where("reason IS NULL").select("code", "symbol", "name", *QUOTE_PLACES, "timestamp", "quote_date", "file")
    return quotes, x.where("reason IS NOT NULL").select("file", F.substring("line", 1, SHOWN).alias("line"), "reason")


def watchlist_files(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, rejected) of files watchlist_YYYYMMDD.json: file, date, code, trigger, stop, target; and file, reason.

    The date in the file's name must be a date and the document's own.
    """
    docs = json_files(spark, glob, WATCHLIST_FILE)
    token = F.regexp_extract("file", r"^watchlist_(\d{8})\.json$", 1)
    named, own = F.try_to_timestamp(token, F.lit("yyyyMMdd")).cast("date"), F.col("date").try_cast("date")
    docs = docs.withColumn("named", named).withColumn("own", own)
    reason = first_reason([("BAD_FILE_NAME", token == ""), ("BAD_FILE_DATE", F.col("named").isNull()), ("BROKEN_JSON", F.col("broken").isNotNull()), ("BAD_DATE", F.col("own").isNull()), ("DATE_MISMATCH", F.col("named") != F.col("own")), ("NO_CANDIDATES", F.col("candidates").isNull())])
    docs = docs.withColumn("reason", reason)
    rows = docs.where("reason IS NULL").select("file", F.col("own").alias("date"), F.explode_outer("candidates").alias("c"))
    return rows.where("c IS NOT NULL").select("file", "date", "c.code", "c.trigger", "c.stop", "c.target"), docs.where("reason IS NOT NULL").select("file", "reason")


def write_documents(df: DataFrame, path: str, name: str, content: str) -> None:
    """Each row of ``df`` as a file of its own: the text ``content``, which may have several lines, named by ``name``.

    Spark writes a folder for each name, and the files are then renamed through its file system; the names are as many as documents.
    """
    staged = f"{path}.staged"
    df.select(F.col(name).alias("__name"), F.col(content).alias("__content")).write.partitionBy("__name").option("lineSep", "\n").text(staged)
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(staged)
    system = base.getFileSystem(conf)
    system.mkdirs(jvm.org.apache.hadoop.fs.Path(path))
    unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    for folder in system.globStatus(jvm.org.apache.hadoop.fs.Path(f"{staged}/__name=*")):
        target = unescape(folder.getPath().getName().split("=", 1)[1])
        parts = system.globStatus(jvm.org.apache.hadoop.fs.Path(folder.getPath(), "part-*"))
        if len(parts) != 1:
            raise ValueError(f"{target}: {len(parts)} rows of one name")
        goal = jvm.org.apache.hadoop.fs.Path(path, target)
        system.mkdirs(goal.getParent())
        if not system.rename(parts[0].getPath(), goal):
            raise OSError(f"{target} could not be renamed")
    system.delete(base, True)
