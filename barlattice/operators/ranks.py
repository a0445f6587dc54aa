"""Ranks, bins and order-sensitive selections within a date (or any group)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(*keys: str):
    return Window.partitionBy(*keys)


def top_fraction(df: DataFrame, keys: list[str], value: str, tie: str, fraction: float = 0.2, ascending: bool = False) -> DataFrame:
    """rank (ties by ``tie``), n and whether the row is among the first ceil(fraction * n) of its group."""
    w = within(*keys)
    order = F.col(value).asc() if ascending else F.col(value).desc()
    x = df.withColumn("rank", F.row_number().over(w.orderBy(order, tie)).cast("long")).withColumn("n", F.count(F.lit(1)).over(w))
    return x.withColumn("selected", F.col("rank") <= F.ceil(fraction * F.col("n")))


def average_rank(keys: list[str], value: str) -> Column:
    """Ranks from 1, ascending; equal values share the mean of their ranks."""
    return F.rank().over(within(*keys).orderBy(value)) + (F.count(F.lit(1)).over(within(*keys, value)) - 1) / 2


def spearman(df: DataFrame, keys: list[str], x: str, y: str, least: int = 2) -> DataFrame:
    """Per group: n and the correlation of average ranks; null under ``least`` rows or without variance."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.select(*keys, average_rank(keys, x).alias("rx"), average_rank(keys, y).alias("ry"))
    g = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.var_pop("rx").alias("vx"), F.var_pop("ry").alias("vy"), F.covar_pop("rx", "ry").alias("c"))
    ic = F.when((F.col("n") >= least) & (F.col("vx") > 0) & (F.col("vy") > 0), F.col("c") / F.sqrt(F.col("vx") * F.col("vy")))
    return g.select(*keys, "n", ic.alias("ic"))


def equal_bins(keys: list[str], order: list, bins: int) -> Column:
    """min(bins, floor(place * bins / n) + 1) with place from 0 in the given order."""
    w = within(*keys)
    place = F.row_number().over(w.orderBy(*order)) - 1
    return F.least(F.lit(bins), F.floor(place * bins / F.count(F.lit(1)).over(w)) + 1).cast("int")


def boundary_weights(df: DataFrame, keys: list[str], score: str, k: int) -> DataFrame:
    """Weights of the k best of each group where those that tie at the boundary share what is left."""
    w = within(*keys)
    x = df.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__place", F.row_number().over(w.orderBy(F.col(score).desc())))
    x = x.withColumn("__edge", F.max(F.when(F.col("__place") == F.least(F.lit(k), F.col("__n")), F.col(score))).over(w))
    x = x.withColumn("__above", F.sum((F.col(score) > F.col("__edge")).cast("int")).over(w)).withColumn("__equal", F.sum((F.col(score) == F.col("__edge")).cast("int")).over(w))
    size = F.least(F.lit(k), F.col("__n"))
    weight = F.when(F.col(score) > F.col("__edge"), 1.0).when(F.col(score) == F.col("__edge"), (size - F.col("__above")) / F.col("__equal")).otherwise(0.0) / size
    return x.withColumn("weight", weight).drop("__n", "__place", "__edge", "__above", "__equal")


def run_lengths(df: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Maximal runs of consecutive places per key: start, length."""
    w = within(*keys).orderBy(place)
    island = df.select(*keys, place, (F.col(place) - F.row_number().over(w)).alias("__island"))
    return island.groupBy(*keys, "__island").agg(F.min(place).alias("start"), F.count(F.lit(1)).alias("length")).drop("__island")


def pareto_fronts(df: DataFrame, key: str, better_high: str, better_low: str, name: str, fronts: int = 3) -> DataFrame:
    """The front (1, 2, ...) of each row within its key for one value to maximise and one to minimise.

    With two values, a row's front is found by peeling: the first front holds the rows that no other
    row beats, that is whose low value is under the least seen among rows of a higher or equal high
    value. Each peel is one window per key; rows behind the last front get null.
    """
    rest, found = df.withColumn("__hi", F.round(better_high, 12)).withColumn("__lo", F.round(better_low, 12)), None
    for front in range(1, fronts + 1):
        w = Window.partitionBy(key).orderBy(F.col("__hi").desc())
        strict = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        # Beaten by a row of higher value and no larger cost, or of equal value and smaller cost.
        least_equal = F.min("__lo").over(Window.partitionBy(key, "__hi"))
        x = rest.withColumn("__here", least_equal)
        x = x.withColumn("__seen", F.min("__lo").over(strict)).withColumn("__rank", F.dense_rank().over(w))
        firsts = x.groupBy(key, "__rank").agg(F.min("__seen").alias("__upto")).withColumn("__next", F.col("__rank") + 1).select(F.col(key).alias("__k"), "__next", "__upto")
        x = x.join(firsts, (F.col(key) == F.col("__k")) & (F.col("__rank") == F.col("__next")), "left")
        on = (F.col("__lo") == F.col("__here")) & (F.col("__upto").isNull() | (F.col("__lo") < F.col("__upto")))
        x = x.withColumn("__on", on)
        part = x.where("__on").select(*df.columns, F.lit(front).alias("front"))
        found = part if found is None else found.unionByName(part)
        rest = x.where("NOT __on").select(*df.columns, "__hi", "__lo")
    return found.unionByName(rest.select(*df.columns, F.lit(None).cast("int").alias("front")))
