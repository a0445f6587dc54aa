"""Join semantics: as-of, last valid record, coverage, merging and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, at: str, when: str, take: list[str]) -> DataFrame:
    """Each left row with the last right row of its key whose ``when`` is not after ``at``.

    Both sides are stacked and one window per key looks back; no pair of rows that do not match is made.
    """
    value = F.struct(*[F.col(c) for c in take])
    rows = right.select(key, F.col(when).alias("__t"), F.lit(0).alias("__side"), value.alias("__v"), F.lit(None).cast(left.schema[at].dataType).alias("__at"))
    asked = left.select(key, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(rows.schema["__v"].dataType).alias("__v"), F.col(at).alias("__at"))
    w = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stacked = rows.unionByName(asked).withColumn("__found", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return stacked.select(key, F.col("__at").alias(at), *[F.col("__found")[c].alias(c) for c in take])


def last_valid(records: DataFrame, key: str, place: str, valid: str, take: list[str]) -> DataFrame:
    """The record of the largest ``place`` among the valid ones of each key."""
    best = records.where(F.col(valid)).groupBy(key).agg(F.max_by(F.struct(*take), place).alias("__best"))
    return best.select(key, *[F.col("__best")[c].alias(c) for c in take])


def coverage(expected: DataFrame, observed: DataFrame, key: str, missing: str, extra: str) -> DataFrame:
    """Keys on one side only, each with its problem."""
    a = expected.join(observed, key, "left_anti").select(key, F.lit(missing).alias("problem"))
    return a.unionByName(observed.join(expected, key, "left_anti").select(key, F.lit(extra).alias("problem")))


def pair_models(prospective: DataFrame, rule: DataFrame) -> DataFrame:
    """Both models' rows of every signal, and how they differ."""
    p = prospective.select("signal_id", F.col("status").alias("prospective_status"), F.col("entry_step").alias("pe"), F.col("return_pct").alias("prospective_return"))
    r = rule.select("signal_id", F.col("status").alias("rule_status"), F.col("entry_step").alias("re"), F.col("return_pct").alias("rule_return"))
    category = F.when(F.col("prospective_status") == F.col("rule_status"), "SAME_STATUS").when(~F.col("pe").eqNullSafe(F.col("re")), "DIFFERENT_ENTRY").otherwise("DIFFERENT_EXIT")
    return p.join(r, "signal_id", "full").select("signal_id", "prospective_status", "rule_status", "prospective_return", "rule_return", category.alias("category"))


def merge_sources(first: DataFrame, second: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows of both sources; the second wins where both have the key, and a difference is marked."""
    a, b = first.select(*keys, F.col(value).alias("__a")), second.select(*keys, F.col(value).alias("__b"))
    x = a.join(b, keys, "full")
    status = F.when(F.col("__b").isNull(), "FIRST_ONLY").when(F.col("__a").isNull(), "SECOND_ONLY").when(F.abs(F.col("__a") - F.col("__b")) <= tolerance, "SAME").otherwise("CONFLICT")
    return x.select(*keys, F.coalesce("__b", "__a").alias(value), status.alias("status"))


def keyed_diff(first: DataFrame, second: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """delta and changed for the keys of both."""
    x = first.select(*keys, F.col(value).alias("__a")).join(second.select(*keys, F.col(value).alias("__b")), keys)
    return x.select(*keys, (F.col("__b") - F.col("__a")).alias("delta"), (F.abs(F.col("__b") - F.col("__a")) > tolerance).alias("changed"))
