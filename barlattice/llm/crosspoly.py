"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, merge_labels, partitions, split_heavy, spread, tidy, trees
from .vectors import matrix, valid

COSINE = 0.98
#: Tables and margin for 1, 2 and 3 functions a table. A bucket is probed where the coordinates that name it come, taken
#: together, within the margin of the largest. In 64 dimensions a pair at cosine 0.98 meets in one table with probability
#: 0.995, 0.936 and 0.874 and is missed by all with 2e-7, 2e-5 and 3e-5; a vector is in 7, 12 and 22 buckets. The margins are
#: those of 64 dimensions; ``reach`` has those of others.
SETTINGS = {1: (3, 0.04), 2: (4, 0.03), 3: (5, 0.03)}
#: Rows of a bucket that one task compares with each other; larger buckets are dealt out as pairs of blocks.
BUCKET = 4096


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The normalised fast Walsh-Hadamard transform of each row, whose length is a power of two."""
    n, d = rows.shape
    size = 1
    while size < d:
        pairs = rows.reshape(n, d // (2 * size), 2, size)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        size *= 2
    return rows / math.sqrt(d)


class Hashes:
    """``tables`` hash tables of ``width`` cross-polytope functions each, for vectors of one length."""

    def __init__(self, dim: int, tables: int, width: int, seed: int = 3):
        self.dim, self.tables, self.width = dim, tables, width
        self.padded = 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng([seed, self.padded]).choice([-1.0, 1.0], (tables, width, 3, self.padded))

    def rotated(self, rows: np.ndarray, table: int, function: int) -> np.ndarray:
        out = np.zeros((len(rows), self.padded))
        out[:, : self.dim] = rows
        for signs in self.signs[table, function]:
            out = hadamard(out * signs)
        return out

    def codes(self, rows: np.ndarray, table: int, function: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest signed axis of each row, and by how much each of the 2 * padded axes falls short of it."""
        turned = self.rotated(rows, table, function)
        both = np.concatenate([turned, -turned], axis=1)
        main = both.argmax(axis=1)
        return main, both[np.arange(len(rows)), main][:, None] - both

    def probes(self, coded: list[tuple[np.ndarray, np.ndarray]], margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket, is it the row's own) of all buckets whose axes together fall short by no more than the margin."""
        n = len(coded[0][0])
        row, code, short, own = np.arange(n), np.zeros(n, np.int64), np.zeros(n), np.ones(n, bool)
        for main, gap in coded:
            i, axis = np.nonzero(gap <= margin)
            counts = np.bincount(i, minlength=n)
            pick = spread((np.cumsum(counts) - counts)[row], counts[row])
            row, code, short, own = (np.repeat(x, counts[row]) for x in (row, code, short, own))
            short = short + gap[row, axis[pick]]
            code, own = code * (2 * self.padded) + axis[pick], own & (axis[pick] == main[row])
            keep = short <= margin
            row, code, short, own = row[keep], code[keep], short[keep], own[keep]
        return row, code, own


def normal(rows: np.ndarray) -> np.ndarray:
    """Unit rows; scaled by the largest component first, so that no square over- or underflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def width_for(rows: int, dim: int) -> int:
    """Functions per table, so that buckets hold some hundred rows."""
    return max(1, round(math.log(max(rows, 2) / 512) / math.log(2 * max(dim, 2)))) if rows > 512 else 1


def reach(width: int, padded: int) -> float:
    """The margin in ``padded`` dimensions: rotated components shrink with the root of the dimension, and so does what two near vectors differ in.

    In two dimensions the four axes are so far apart that either of two vectors at cosine 0.98 falls short of the other's
    axis by 0.1415 at most.
    """
    usual = SETTINGS.get(width, SETTINGS[max(SETTINGS)])[1] * math.sqrt(64 / padded)
    return max(usual, 0.1415 * width) if padded == 2 else usual


def links(vectors: DataFrame, width: int, cosine: float, tables: int, margin: float | None, bucket: int) -> DataFrame:
    """(a, b, n): vector a, its parent in a tree over its set within one bucket, and its links counted there.

    A pair counts only in the first bucket where it can be found, so that the sum of n over all
    buckets is the number of its links; pairs themselves never leave a task.
    """
    cache: dict[int, Hashes] = {}

    def hashes(dim: int) -> Hashes:
        if dim not in cache:
            cache.clear()
            cache[dim] = Hashes(dim, tables, width)
        return cache[dim]

    @tidy
    def deal(batches):
        for batch in batches:
            for dim in np.unique(batch.column(3).to_numpy()):
                part = batch.filter(pa.array(batch.column(3).to_numpy() == dim))
                for a in range(0, part.num_rows, 4096):
                    some = part.slice(a, 4096)
                    rows, h = normal(matrix(some.column(2))), hashes(int(dim))
                    for t in range(tables):
                        source, bucket_ids, first = h.probes([h.codes(rows, t, f) for f in range(width)], reach(width, h.padded) if margin is None else margin)
                        taken = some.take(pa.array(source))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(source), t, np.int32)), taken.column(1), pa.array(bucket_ids), pa.array(first), taken.column(0), taken.column(2), taken.column(3)], names=["tab", "label", "bucket", "main", "id", "v", "dim"])

    label_type, vector_type = (vectors.schema[c].dataType.simpleString() for c in ("label", "v"))
    keys = ["tab", "label", "dim", "bucket"]
    dealt = vectors.select("id", "label", "v", "dim").mapInArrow(deal, f"tab int, label {label_type}, bucket long, main boolean, id long, v {vector_type}, dim int")
    dealt = split_heavy(dealt, keys, "id", bucket)

    def compare(rows: pa.Table):
        """One (bucket, lo, hi)."""
        t, code, lo, hi = (rows[c][0].as_py() for c in ("tab", "bucket", "lo", "hi"))
        ids, main, block = rows["id"].to_numpy(), rows["main"].to_numpy(zero_copy_only=False).astype(bool), rows["block"].to_numpy()
        unit = normal(matrix(rows["v"]))
        h = hashes(unit.shape[1])
        most = reach(width, h.padded) if margin is None else margin
        lefts, rights = [], []
        for a in range(0, len(ids), 512):
            close = unit[a : a + 512] @ unit[a:].T >= cosine
            i, j = np.nonzero(close)
            i, j = i + a, j + a
            fits = (i < j) & (main[i] | main[j]) & ((block[i] != block[j]) if lo != hi else True) & (ids[i] != ids[j])
            lefts.append(i[fits])
            rights.append(j[fits])
        i, j = np.concatenate(lefts), np.concatenate(rights)
        if not len(i):
            return None
        used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        x, y = back[: len(i)], back[len(i) :]
        first = np.ones(len(i), bool)
        for table in range(t + 1):
            coded = [h.codes(unit[used], table, f) for f in range(width)]
            forth = sum(gap[y, m[x]] for m, gap in coded) <= most  # x's own bucket, probed by y
            back_ = sum(gap[x, m[y]] for m, gap in coded) <= most
            if table < t:
                first &= ~(forth | back_)
            else:
                own = np.zeros(len(used), np.int64)
                for m, _ in coded:
                    own = own * 2 * h.padded + m
                top = np.iinfo(np.int64).max
                first &= np.minimum(np.where(forth, own[x], top), np.where(back_, own[y], top)) == code
        counts = np.bincount(x[first], minlength=len(used)) + np.bincount(y[first], minlength=len(used))
        parent = np.arange(len(used))
        child, above = trees(merge_labels(np.arange(len(used)), x, y))
        parent[child] = above
        return pa.RecordBatch.from_arrays([pa.array(ids[used]), pa.array(ids[used][parent]), pa.array(counts.astype(np.int64))], names=["a", "b", "n"])

    @tidy
    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            change = np.zeros(table.num_rows, bool)
            for c in (*keys, "lo", "hi"):
                values = table[c].to_numpy(zero_copy_only=False)
                change[1:] |= values[1:] != values[:-1]
            edges = [0, *np.flatnonzero(change).tolist()]
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a > 1 and (out := compare(table.slice(a, b - a))) is not None:
                    yield out
            held = table.slice(edges[-1])
        if held is not None and held.num_rows > 1 and (out := compare(held)) is not None:
            yield out

    together = dealt.repartition(partitions(vectors.sparkSession) * 2, *keys, "lo", "hi").sortWithinPartitions(*keys, "lo", "hi")
    return together.select(*keys, "lo", "hi", "block", "main", "id", "v").mapInArrow(run, "a long, b long, n long")


def near_duplicates(df: DataFrame, cosine: float = COSINE, tables: int | None = None, margin: float | None = None, bucket: int = BUCKET, width: int | None = None) -> DataFrame:
    """One row per row of ``df`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null and their cosine, in double precision, is
    at least ``cosine``; every link is verified. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null label or vec_id, link with nothing; such a row has
    n_links 0 and its own vec_id as component_id. Vectors of different lengths do not link. vec_id is
    taken as a key; rows of one vec_id never link with each other. Empty tables give empty results.
    ``width`` and ``tables`` follow from the number of rows, ``margin`` from the width and the dimension, unless given.
    """
    usable = valid(df, "embedding").where("label IS NOT NULL AND vec_id IS NOT NULL")
    vectors = usable.select(F.col("vec_id").cast("long").alias("id"), "label", F.col("embedding").alias("v"), F.size("embedding").alias("dim"))
    size = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(2))).first()
    width = width or min(width_for(*size), max(SETTINGS))
    usual = SETTINGS.get(width, SETTINGS[max(SETTINGS)])
    found = cut(links(vectors, width, cosine, tables or usual[0], margin, bucket))
    counts = found.groupBy(F.col("a").alias("__c")).agg(F.sum("n").alias("__n"))
    joined = components(found.select("a", "b")).select(F.col("node").alias("__node"), "component")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = rows.join(counts, rows["vec_id"] == counts["__c"], "left").join(joined, rows["vec_id"] == joined["__node"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("__n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
