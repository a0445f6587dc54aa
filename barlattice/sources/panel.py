"""Adapters from the supplied tables to the daily-bar model, each with the same relation as DuckDB SQL."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Line items of one symbol that one task may have.
TOGETHER = 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def symbol_of(key):
    """Eight digits: a board prefix by key and the key itself."""
    prefix = F.element_at(F.array(F.lit("60"), F.lit("00"), F.lit("30"), F.lit("68")), (key % 4 + 1).cast("int"))
    return F.concat(prefix, F.lpad(key.cast("string"), 6, "0"))


SYMBOL = "(CASE CAST({0} AS BIGINT) % 4 WHEN 0 THEN '60' WHEN 1 THEN '00' WHEN 2 THEN '30' ELSE '68' END || lpad(CAST({0} AS VARCHAR), 6, '0'))"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of the line items of ``sf_dir``."""
    return bars_of(read(spark, sf_dir, "lineitem"))


def bars_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of all symbols but the null one, for windows over symbols.

    Where no symbol has more than TOGETHER line items, these are exchanged by symbol, and bars made and kept there: one exchange and not two.
    """
    lines = read(spark, sf_dir, "lineitem").where("l_suppkey IS NOT NULL")
    most = lines.groupBy(symbol_of(F.col("l_suppkey")).alias("symbol")).count().agg(F.max("count")).first()[0]
    return bars_of(lines, together=(most or 0) <= TOGETHER)


def bars_of(lineitem: DataFrame, together: bool = False) -> DataFrame:
    """symbol, date, open, high, low, close, volume, turnover.

    Line items are aggregated where they are read, then by (symbol, date); so only bars, of which a symbol
    has one a day, are ever brought together by symbol, however many line items it has. With ``together``
    a symbol's line items are.
    """
    lines = lineitem.select(
        symbol_of(F.col("l_suppkey")).alias("symbol"), F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"
    )
    if together:
        lines = lines.repartition("symbol")
    lines = lines.withColumn("px", 10 + F.sqrt("l_extendedprice") / 300)
    # The order of a day's lines, (order, line, part, price in cents), as one number: with it the aggregate needs no sort.
    first = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    then = F.col("l_partkey") * 100_000_000 + F.round(F.col("l_extendedprice") * 100).cast("long")
    order = (first.cast("decimal(18,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)") + then.cast("decimal(19,0)")).cast("decimal(38,0)")
    return lines.groupBy("symbol", "date").agg(
        F.min_by("px", order).alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", order).alias("close"),
        F.sum(F.sqrt("l_quantity") * 10).alias("volume"),
        F.round(F.sum("l_extendedprice"), 2).alias("turnover"),
    )


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share.

    Where ``spark.checkpoint.dir`` is unset, a local master, as in tests, gets a temporary folder and a
    cluster an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp("-checkpoints")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there.

    For a panel that a query uses several times: the line items behind it are then read once.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(bars(spark, sf_dir))


BARS = f"""bars AS (
  SELECT {SYMBOL.format('l_suppkey')} AS symbol, CAST(l_shipdate AS DATE) AS date,
         arg_min(10 + sqrt(l_extendedprice) / 300, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open,
         max(10 + sqrt(l_extendedprice) / 300) AS high, min(10 + sqrt(l_extendedprice) / 300) AS low,
         arg_max(10 + sqrt(l_extendedprice) / 300, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close,
         sum(sqrt(l_quantity) * 10) AS volume, round(sum(l_extendedprice), 2) AS turnover
  FROM lineitem GROUP BY 1, 2)"""


def sessions(panel: DataFrame) -> DataFrame:
    """date and pos (1, 2, ...): one row per session of the panel, a small dimension."""
    return panel.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")))


SESSIONS = "sessions AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM bars))"


def numbered(panel: DataFrame) -> DataFrame:
    """Adds rn, the place of a bar in its symbol's own history."""
    return panel.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy("date")))


NUMBERED = "nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars)"


def index_bars(panel: DataFrame) -> DataFrame:
    """The benchmark: mean close and total volume of each session."""
    return panel.groupBy("date").agg(F.avg("close").alias("close"), F.sum("volume").alias("volume"))


INDEX = "idx AS (SELECT date, avg(close) AS close, sum(volume) AS volume FROM bars GROUP BY date)"


def corporate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two events per symbol from the supplier keys; absent amounts are null in the source and 0 here."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    raw = s.select(symbol_of(k).alias("symbol"), k, F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    first = F.date_add(F.lit("1996-01-01").cast("date"), (k * 37 % 1200).cast("int"))
    raw = raw.select(
        "symbol",
        F.date_add(first, (F.col("n") * 400).cast("int")).alias("ex_date"),
        F.when((k + F.col("n")) % 3 > 0, 0.05 * ((k + F.col("n")) % 3)).alias("dividend"),
        F.when((k + F.col("n")) % 2 == 0, F.lit(0.1)).alias("bonus"),
        F.when(k % 5 == 0, F.lit(0.05)).alias("allotment"),
        F.when(k % 5 == 0, F.lit(8.0)).alias("allotment_price"),
    )
    return raw.na.fill(0.0)


EVENTS = f"""ev AS (
  SELECT {SYMBOL.format('s_suppkey')} AS symbol,
         CAST(DATE '1996-01-01' + CAST(s_suppkey * 37 % 1200 AS INTEGER) + CAST(n * 400 AS INTEGER) AS DATE) AS ex_date,
         CAST(CASE WHEN (s_suppkey + n) % 3 > 0 THEN 0.05::DOUBLE * ((s_suppkey + n) % 3) ELSE 0 END AS DOUBLE) AS dividend,
         CASE WHEN (s_suppkey + n) % 2 = 0 THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS bonus,
         CASE WHEN s_suppkey % 5 = 0 THEN 0.05::DOUBLE ELSE 0::DOUBLE END AS allotment,
         CASE WHEN s_suppkey % 5 = 0 THEN 8.0::DOUBLE ELSE 0::DOUBLE END AS allotment_price
  FROM supplier, (VALUES (0), (1)) AS v(n))"""


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol and sector, the supplier's nation."""
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(symbol_of(F.col("s_suppkey")).alias("symbol"), F.col("n_name").alias("sector"))


SECTORS = f"sec AS (SELECT {SYMBOL.format('s_suppkey')} AS symbol, n_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def sector_ranks(panel: DataFrame, membership: DataFrame) -> DataFrame:
    """Per date: each sector's mean daily change in percent and its rank (change descending, name ascending)."""
    w = Window.partitionBy("symbol").orderBy("date")
    changed = panel.withColumn("chg", F.try_divide(F.col("close"), F.lag("close").over(w)) * 100 - 100).where("chg IS NOT NULL")
    mean = changed.join(membership, "symbol").groupBy("date", "sector").agg(F.round(F.avg("chg"), 6).alias("sector_chg"))
    return mean.withColumn("sector_rank", F.row_number().over(Window.partitionBy("date").orderBy(F.col("sector_chg").desc(), "sector")))


SECTOR_RANKS = """chg AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) * 100 - 100 AS chg FROM bars),
sr AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY sector_chg DESC, sector) AS sector_rank FROM (
  SELECT date, sector, round(avg(chg), 6) AS sector_chg FROM chg JOIN sec USING (symbol) WHERE chg IS NOT NULL GROUP BY date, sector))"""


def signal_bars(panel: DataFrame) -> DataFrame:
    """The bars that are signals, with all their columns, rn and signal_id: from the 120th on, closing above the 20 closes before."""
    before = F.max("close").over(Window.partitionBy("symbol").orderBy("date").rowsBetween(-20, -1))
    x = numbered(panel.withColumn("before", before)).where((F.col("rn") >= 120) & (F.col("close") > F.col("before"))).drop("before")
    return x.withColumn("signal_id", F.concat_ws(":", "symbol", F.col("date").cast("string")))


def signals(panel: DataFrame) -> DataFrame:
    """Signals: trigger just above the bar's high, stop below its low, target beyond."""
    return signal_bars(panel).select(
        "signal_id", "symbol", F.col("date").alias("signal_date"), "rn", "close",
        F.round(F.col("high") * 1.0005, 4).alias("trigger"), F.round(F.col("low") * 0.995, 4).alias("stop"), F.round(F.col("high") * 1.02, 4).alias("target"),
    )


SIGNALS = """sig AS (
  SELECT symbol || ':' || CAST(date AS VARCHAR) AS signal_id, symbol, date AS signal_date, rn, close,
         round(high * 1.0005, 4) AS trigger, round(low * 0.995, 4) AS stop, round(high * 1.02, 4) AS target
  FROM (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS before FROM nb) WHERE rn >= 120 AND close > before)"""


def outcomes(panel: DataFrame, horizons: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Signals with their forward returns on each symbol's own clock: next open to the close h bars on, in percent."""
    w = Window.partitionBy("symbol").orderBy("date")
    ahead = panel.withColumn("entry", F.lead("open").over(w))
    for h in horizons:
        span = w.rowsBetween(1, h)
        full = F.count("close").over(span) == h
        ahead = ahead.withColumn(f"ret{h}", F.when(full, (F.lead("close", h).over(w) / F.col("entry") - 1) * 100))
        ahead = ahead.withColumn(f"mfe{h}", F.when(full, (F.max("high").over(span) / F.col("entry") - 1) * 100))
        ahead = ahead.withColumn(f"mae{h}", F.when(full, (F.min("low").over(span) / F.col("entry") - 1) * 100))
    return numbered(ahead).where("rn >= 120")


def _ahead(h: int) -> str:
    f = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    full = f"CASE WHEN count(close) {f} = {h} THEN"
    entry = "lead(open) OVER (PARTITION BY symbol ORDER BY date)"
    return (
        f"{full} (lead(close, {h}) OVER (PARTITION BY symbol ORDER BY date) / {entry} - 1) * 100 END AS ret{h}, "
        f"{full} (max(high) {f} / {entry} - 1) * 100 END AS mfe{h}, {full} (min(low) {f} / {entry} - 1) * 100 END AS mae{h}"
    )


OUTCOMES = f"""out AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, lead(open) OVER (PARTITION BY symbol ORDER BY date) AS entry,
         {', '.join(_ahead(h) for h in (1, 3, 5, 10))} FROM bars) WHERE rn >= 120)"""
