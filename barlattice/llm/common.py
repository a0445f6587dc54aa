"""Helpers shared by the operators: lineage cuts, Arrow text buffers, hot-bucket splitting, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice.sources.shipping import ship  # noqa: F401

#: Rows of a few numbers each that may be broadcast, once counted.
BROADCAST_ROWS = 10_000
#: The words of the contracts.
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset, a local master (as in
    tests) gets a temporary folder, and a cluster an error, as its machines share no such folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp("-checkpoints")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def tidy(function):
    """For functions of mapInArrow: give freed memory back to the system when a task's rows are done.

    Python workers stay for later tasks, and the C allocators keep what was freed; without this, idle
    workers hold the peak of their last task beside whatever the executor does next.
    """

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library: it keeps its own counsel
                pass

    return run


def partitions(spark: SparkSession, scanned: DataFrame | None = None) -> int:
    """The session's shuffle partitions; not fewer than the parts that a table is read in, so that they grow with its bytes."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return least if scanned is None else max(least, scanned.rdd.getNumPartitions())


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without copies, and n + 1 offsets; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose texts together hold about ``size`` bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` (``counts[i]`` of them), for all i in a row."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of ``a[i]`` and ``b[i]``; each label is the smallest index of its set."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return labels
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(labels, high, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def trees(labels: np.ndarray, fanout: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(child, parent) for the members of every set: a tree of small fan-out, so that no node gets many edges."""
    order = np.argsort(labels, kind="stable")
    own = labels[order]
    first = np.searchsorted(own, own)
    place = np.arange(len(order)) - first
    child = place > 0
    return order[child], order[first[child] + (place[child] - 1) // fanout]


def split_heavy(df: DataFrame, keys: list[str], identity: str, limit: int) -> DataFrame:
    """Give every row of a bucket of over ``limit`` rows to block pairs of that bucket.

    Adds ``block`` (the row's own block) and ``lo``, ``hi`` (the pair of blocks this copy is for).
    A task that handles one (keys, lo, hi) sees at most about two times ``limit`` rows, whatever the
    size of the bucket, and every pair of rows meets in exactly one (lo, hi), if ``lo < hi`` tasks
    compare only rows of different blocks.
    """
    heavy = df.groupBy(*keys).count().where(F.col("count") > limit)
    heavy = cut(heavy.select(*[F.col(k).alias(f"__{k}") for k in keys], F.ceil(F.col("count") / limit).cast("int").alias("__blocks")))
    many = heavy.limit(BROADCAST_ROWS + 1).count()
    if not many:
        return df.select("*", F.lit(0).alias("block"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    match = [F.col(k) == F.col(f"__{k}") for k in keys]
    joined = df.join(F.broadcast(heavy) if many <= BROADCAST_ROWS else heavy, match, "left").drop(*[f"__{k}" for k in keys])
    joined = joined.withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    joined = joined.withColumn("block", F.pmod(F.xxhash64(identity), F.col("__blocks")).cast("int"))
    joined = joined.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return joined.select(*df.columns, "block", F.least("block", "__other").alias("lo"), F.greatest("block", "__other").alias("hi"))


def salted(left: DataFrame, right: DataFrame, left_key: str, right_key: str, spread_by: str, salts: int = 16) -> DataFrame:
    """Inner join on ``left_key = right_key`` where a key may hold any share of the left rows.

    The left rows of a key go to ``salts`` tasks by ``spread_by``; the right rows, one per key, go to all.
    Both sides are dealt out explicitly: else the planner, finding one side by its key already, would
    bring the other to it by the key alone.
    """
    n = partitions(left.sparkSession)
    l = left.withColumn("__salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).repartition(n, left_key, "__salt")
    r = right.withColumn("__right_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).repartition(n, right_key, "__right_salt")
    return l.join(r, (F.col(left_key) == F.col(right_key)) & (F.col("__salt") == F.col("__right_salt"))).drop("__salt", "__right_salt")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (node, component) per node that has an edge.

    Smallest-label propagation with pointer jumping; every round is cut into the checkpoint folder.
    The edges are flat trees made inside the buckets, so that few rounds are needed. ``component`` is
    the smallest node reachable. A node with very many edges, or a component with very many nodes, is
    spread over tasks by salt.
    """
    one_way = edges.select("a", "b").where("a <> b").distinct()
    both = cut(one_way.union(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")))
    for _ in range(most_rounds):
        seen = salted(both, labels, "b", "node", "a").groupBy("a").agg(F.min("component").alias("__near"))
        nearer = labels.join(seen, labels["node"] == seen["a"], "left").select("node", F.col("component").alias("__old"), F.least("component", F.coalesce("__near", "component")).alias("component"))
        upper = nearer.select(F.col("node").alias("__up"), F.col("component").alias("__upper"))
        jumped = cut(salted(nearer, upper, "component", "__up", "node").select("node", "__old", F.col("__upper").alias("component")))
        labels = jumped.select("node", "component")
        if jumped.where("component <> __old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
