"""Summaries of outcomes, and resampled confidence intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from barlattice.sources.panel import kept

#: Rows of a part that one task sorts, and rows of a few numbers each that may be broadcast, once counted.
RANGE, FEW = 500_000, 10_000
#: Sampled keys, about, that long groups are cut at to count their ranges.
CUTS = 8192
#: JSON that keeps microseconds.
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def rate(condition: Column) -> Column:
    return F.avg(F.when(condition.isNotNull(), condition.cast("int")))


def range_count(spark: SparkSession, rows: int | None = None) -> int:
    """As many parts as shuffle partitions; more where ``rows``, the number of rows if known, would make a part larger than RANGE."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return least if rows is None else max(least, -(-rows // RANGE))


def numbered_ranges(df: DataFrame, order: list[str], rows: int | None = None) -> DataFrame:
    """``df`` parted into ranges of ``order``, written once, with the column ``__range``, which ascends with the order.

    Ranges are as many as ``range_count`` says and hold about equal shares, so that a task has its range only.
    """
    parts = range_count(df.sparkSession, rows)
    return kept(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))


def places(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``, each row's place (from 0) in the order over the whole table, and ``__all``, the number of rows.

    A row's place is the rows of the ranges before its own and its place within; no task has all rows.
    """
    x = numbered_ranges(df, order)
    sizes = x.groupBy(F.col("__range").alias("__r")).agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(Window.orderBy("__r"))  # one row for each range
    sizes = sizes.select("__r", (upto - F.col("__c")).alias("__before"), F.sum("__c").over(Window.partitionBy()).alias("__all"))
    x = x.join(F.broadcast(sizes), F.col("__range") == F.col("__r"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return x.withColumn(name, place).drop("__range", "__r", "__before")


def group_places(df: DataFrame, key: str, order: list, name: str) -> DataFrame:
    """Adds ``name``, each row's place (from 0) in the order within its key, and ``__size``, the key's rows.

    The table is numbered in ranges; a key that has all rows is many ranges.
    """
    x = places(df, [F.col(key), *order], "__place")
    starts = kept(x.groupBy(F.col(key).alias("__key")).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__size")))
    few = starts.limit(FEW + 1).count() <= FEW  # then the rows need no further exchange
    x = x.join(F.broadcast(starts) if few else starts, F.col(key).eqNullSafe(F.col("__key")))
    return x.withColumn(name, F.col("__place") - F.col("__first")).drop("__place", "__first", "__key", "__all")


def cuts_below(df: DataFrame, cuts: DataFrame, name: str) -> DataFrame:
    """Adds ``name``, how many cuts of its group are not above each row: groups are numbers ``__no``, rows and ``cuts`` have structs ``__at``.

    The cuts, few, become a sorted literal that is searched by halves where the rows are; a group without cuts has none below.
    """
    cut = F.struct("__no", "__at")
    kind = cuts.select(cut.alias("cut")).schema["cut"].dataType
    lines = cuts.select(F.to_json(cut, EXACT).alias("line"), F.from_json(F.to_json(cut, EXACT), kind, EXACT).eqNullSafe(cut).alias("same")).collect()
    if not all(r.same for r in lines):
        raise ValueError(f"values of {kind.simpleString()} that JSON changes")
    of = F.sort_array(F.from_json(F.lit(f"[{','.join(r.line for r in lines)}]"), ArrayType(kind), EXACT))
    spans = cuts.groupBy(F.col("__no").alias("__g")).agg(F.count(F.lit(1)).cast("int").alias("__len"))
    spans = kept(spans.withColumn("__from", F.coalesce(F.sum("__len").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")))
    longest = spans.agg(F.max("__len")).first()[0] or 0
    x = df.join(F.broadcast(spans), F.col("__no") == F.col("__g"), "left")

    def further(n, step):
        return F.when((n + step <= F.col("__len")) & (F.get(of, F.col("__from") + n + step - 1)["__at"] <= F.col("__at")), n + step).otherwise(n)

    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, longest.bit_length())))])
    return x.withColumn(name, F.coalesce(F.aggregate(steps, F.lit(0), further), F.lit(0))).drop("__g", "__len", "__from")


def group_stretches(df: DataFrame, key: str, order: list[str], rows: int, name: str) -> DataFrame:
    """Adds ``name``, the stretch of ``rows`` places (from 0) that each row's place in the order within its key is in.

    ``df`` is read several times and must give the same rows, but few of them are exchanged: keys of more than ``rows`` rows
    are cut into ranges at sampled rows, the ranges are counted where they are read, and only ranges with an end of a
    stretch are numbered, for the row that begins the next. The sample decides how many these are, and not the result.
    """
    long = df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows)
    long = kept(long.withColumn("__no", F.row_number().over(Window.orderBy("__key"))))  # one row for ``rows`` rows at most
    total = long.agg(F.sum("__n")).first()[0]
    if total is None:
        return df.withColumn(name, F.lit(0).cast("long"))

    def key_of(columns):
        return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)])

    def numbered(columns, how):
        return df.join(F.broadcast(long.drop("__n")), F.col(key).eqNullSafe(F.col("__key")), how).drop("__key").withColumn("__at", key_of(columns))

    x = numbered(order[:-1] or order, "inner")  # without the last column, a line most often, ranges are as good
    sample = kept(x.where(F.pmod(F.xxhash64("__no", "__at"), F.lit(max(1, total // CUTS))) == 0).select("__no", "__at").distinct())
    x = cuts_below(x, sample, "__range")
    upto = F.sum("__c").over(Window.partitionBy("__no").orderBy("__range"))
    ranges = x.groupBy("__no", "__range").agg(F.count(F.lit(1)).alias("__c")).select("__no", "__range", (upto - F.col("__c")).alias("__first"), upto.alias("__upto"))
    begin = F.greatest(F.floor((F.col("__first") - 1) / rows), F.lit(0))
    torn = kept(ranges.where(begin < F.floor((F.col("__upto") - 1) / rows)))  # at most one for each stretch
    w = Window.partitionBy("__no", "__range").orderBy(*order)
    at = [(F.col("__first") + n.over(w) - 1).alias(p) for n, p in ((F.row_number(), "__place"), (F.rank(), "__like"))]
    begins = x.join(F.broadcast(torn), ["__no", "__range"]).select("__no", key_of(order).alias("__at"), *at)
    begins = kept(begins.where("__place > 0").where(F.col("__place") % rows == 0))
    x = cuts_below(numbered(order, "left"), begins.select("__no", "__at"), name).withColumn(name, F.col(name).cast("long"))
    own = [*df.columns, name]
    tied = begins.where("__like < __place").select("__no", "__at", "__like").distinct()
    if tied.isEmpty():
        return x.select(*own)
    # Of rows that equal the first of a stretch some are before it; which of them does not matter.
    equal = x.drop(name).join(F.broadcast(tied), ["__no", "__at"])
    place = F.col("__like") + F.row_number().over(Window.partitionBy("__no", "__at").orderBy("__like")) - 1
    return x.join(F.broadcast(tied), ["__no", "__at"], "left_anti").select(*own).unionByName(equal.withColumn(name, F.floor(place / rows)).select(*own))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], rows: int | None = None) -> DataFrame:
    """``keys`` and ``quantiles``, the exact interpolated quantiles of the non-null values of each key, as an array.

    Equal values are counted first, then the distinct ones are parted into ranges, so that a key that
    has all rows, or a value that most rows have, is no single task's. With ``rows``, the number of rows,
    a task's share does not grow with them.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    x = numbered_ranges(counted, [*keys, "__v"], rows)
    own = Window.partitionBy(*[F.col(f"__{k}") for k in keys])
    sizes = x.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__r")).agg(F.sum("__c").alias("__s"))
    sizes = sizes.select("*", (F.sum("__s").over(own.orderBy("__r")) - F.col("__s")).alias("__before"), F.sum("__s").over(own).alias("__n"))
    match = F.col("__range") == F.col("__r")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    x = x.join(F.broadcast(sizes), match)  # one row for each range, and one more for each key
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy("__range", *keys).orderBy("__v"))
    x = x.withColumn("__upto", upto)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("__upto") - F.col("__c") <= rank) & (rank < F.col("__upto")), F.col("__v")))

    out = []
    for q in probabilities:
        exact = F.lit(q) * (F.col("__n") - 1)
        low, high = at(F.floor(exact)), at(F.ceil(exact))
        out.append(low + (high - low) * F.max(exact - F.floor(exact)))
    return x.groupBy(*keys).agg(F.array(*out).alias("quantiles"))


def summary(value: str, mfe: str | None = None, mae: str | None = None, median: bool = True) -> list[Column]:
    """n, positive rate, means of all, of gains and of losses, median, extremes and mean excursions.

    The median here takes the values of a group into one task; for large groups leave it to ``exact_quantiles``.
    """
    v = F.col(value)
    out = [
        F.count(value).alias("n"), F.round(rate(v > 0), 6).alias("positive_rate"), F.round(F.avg(value), 6).alias("mean"), F.round(F.avg(F.when(v > 0, v)), 6).alias("mean_gain"), F.round(F.avg(F.when(v < 0, v)), 6).alias("mean_loss"),
        *([F.round(F.expr(f"percentile({value}, 0.5)"), 6).alias("median")] if median else []), F.round(F.min(value), 6).alias("min"), F.round(F.max(value), 6).alias("max"),
    ]
    if mfe:
        out += [F.round(F.avg(mfe), 6).alias("mean_mfe"), F.round(F.avg(mae), 6).alias("mean_mae")]
    return out


def daily_equal(df: DataFrame, date: str, value: str, groups: list[str]) -> DataFrame:
    """Mean per date, then the mean of those means: every date weighs the same."""
    return df.groupBy(*groups, date).agg(F.avg(value).alias("__m")).groupBy(*groups).agg(F.count(F.lit(1)).alias("n_dates"), F.round(F.avg("__m"), 6).alias("daily_mean"))


def moving_block_interval(series: DataFrame, keys: list[str], order: str, value: str, block: int = 20, repetitions: int = 5000, seed: int = 20260906) -> DataFrame:
    """Keys, n, low, high: 2.5 and 97.5 percent quantiles of the mean under a moving-block bootstrap.

    A key's series is its daily means, one row per session, so a group is small whatever the panel's
    width. A series shorter than a block is one block. The generator is numpy's PCG64 with the seed.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].dropna().to_numpy(float)
        n = len(x)
        out = pdf[keys].iloc[:1].copy()
        out["n"] = n
        if not n:
            out["low"], out["high"] = np.nan, np.nan
            return out
        size = min(block, n)
        per = -(-n // size)
        rng = np.random.Generator(np.random.PCG64(seed))
        means = np.empty(repetitions)
        for a in range(0, repetitions, 250):
            m = min(250, repetitions - a)
            starts = rng.integers(0, n - size + 1, (m, per))
            means[a : a + m] = x[(starts[:, :, None] + np.arange(size)).reshape(m, -1)[:, :n]].mean(axis=1)
        out["low"], out["high"] = np.quantile(means, [0.025, 0.975])
        return out

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in series.schema if f.name in keys)
    return series.groupBy(*keys).applyInPandas(run, f"{types}, n long, low double, high double")


def date_bootstrap(daily: DataFrame, columns: list[str], draws: int = 10_000, seed: int = 20260906) -> DataFrame:
    """Quantiles of the joint means of ``columns`` when dates are drawn with replacement.

    ``daily`` has one row per date; each chunk of 250 draws is a task of its own. Rows with a null take no part; without rows
    the quantiles are null.
    """
    rows = daily.select(*columns).dropna()
    n_chunks = draws // 250
    packed = rows.groupBy().agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))  # one row per date: small
    spread = packed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))).repartition("chunk")

    def run(batches):
        for pdf in batches:
            for chunk, values in zip(pdf["chunk"], pdf["rows"]):
                x = np.array([[r[c] for c in columns] for r in values], float)
                if not len(x):
                    continue
                rng = np.random.Generator(np.random.PCG64([seed, int(chunk)]))
                picks = rng.integers(0, len(x), (250, len(x)))
                yield pd.DataFrame(x[picks].mean(axis=1), columns=columns)

    means = spread.mapInPandas(run, ", ".join(f"{c} double" for c in columns))
    aggs = [F.expr(f"percentile({c}, array(0.025, 0.975))").alias(c) for c in columns]
    one = means.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c)[0].alias("low"), F.col(c)[1].alias("high")) for c in columns])).alias("r")).select("r.*")


def outcome_metrics(rows: DataFrame, key: str, period: str, total: str = "ALL") -> DataFrame:
    """Counts, rates, means, expectancy, exact medians of excursions and extremes of ``ret``, ``mfe``, ``mae`` per key and period, and per key.

    Periods are aggregated once and the totals made of them. A return of zero counts with the losses. The expectancy is
    the share of gains times their mean and the rest times its mean; where one of both is missing, the mean.
    """
    v = F.col("ret")
    gain = F.when(v > 0, v)
    parts = {"n": F.count(F.lit(1)), "positive": F.count(gain), "s": F.sum(v), "sp": F.sum(gain), "sn": F.sum(F.when(v <= 0, v)), "sf": F.sum("mfe"), "nf": F.count("mfe"), "sa": F.sum("mae"), "na": F.count("mae"), "lo": F.min(v), "hi": F.max(v)}
    per = kept(rows.groupBy(key, period).agg(*[e.alias(c) for c, e in parts.items()]))
    fold = [(F.min if c == "lo" else F.max if c == "hi" else F.sum)(c).alias(c) for c in parts]
    x = per.unionByName(per.groupBy(key).agg(*fold).withColumn(period, F.lit(total)))
    medians = None
    for value in ("mfe", "mae"):
        own = exact_quantiles(rows, [key, period], value, [0.5]).unionByName(exact_quantiles(rows, [key], value, [0.5]).withColumn(period, F.lit(total)))
        own = own.select(key, period, F.col("quantiles")[0].alias(f"median_{value}"))
        medians = own if medians is None else medians.join(own, [key, period], "full")
    x = x.join(medians, [key, period], "left")
    n, positive = F.col("n"), F.col("positive")
    mean, up, down = F.col("s") / n, F.try_divide(F.col("sp"), positive), F.try_divide(F.col("sn"), n - positive)
    share = positive / n
    return x.select(
        key, period, n.alias("sample_count"), positive.alias("positive_count"), (n - positive).alias("non_positive_count"), share.alias("positive_rate"), F.coalesce(share * up + (1 - share) * down, mean).alias("expectancy"),
        mean.alias("mean_return"), up.alias("mean_positive"), down.alias("mean_non_positive"), F.try_divide("sf", "nf").alias("mean_mfe"), "median_mfe", F.try_divide("sa", "na").alias("mean_mae"), "median_mae", F.col("lo").alias("min_return"), F.col("hi").alias("max_return"),
    )
