"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import scramble, word_tokens
from .common import cut, runs, text_buffer, tidy

#: Buckets of hashed words and word pairs.
BUCKETS = 1 << 14
#: Bound on the labelled documents that the target model is made of.
TARGET_ROWS = 20_000
#: Share of the documents that is selected.
SHARE = 0.85
SMOOTHING = 1.0
#: Bands in which keys are counted to find the last one selected.
BANDS = 4096
#: Labelled documents, by crc32 of doc_id as text mod 4: 2 are for the report, 3 for the choice of SHARE; the model has the rest.
REPORT, CHOICE = 2, 3


def label_part(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def grams(texts: pa.Array, buckets: int):
    """(first document, offsets, buckets) of the words and word pairs of runs of a batch's texts."""
    data, offsets = text_buffer(pc.utf8_lower(texts.cast(pa.large_string())))
    for i, j in runs(offsets, 1 << 22):
        tokens, firsts = word_tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        pairs = scramble(tokens[:-1] * np.uint64(3) + tokens[1:])
        inside = np.ones(len(pairs), bool)
        inside[firsts[1:-1][(firsts[1:-1] > 0) & (firsts[1:-1] < len(tokens))] - 1] = False
        owner = np.repeat(np.arange(i, j), np.diff(firsts))
        shift = np.uint64(64 - int(buckets).bit_length() + 1)
        codes = np.concatenate([tokens >> shift, (pairs >> shift)[inside]]).astype(np.int64)
        yield np.concatenate([owner, owner[:-1][inside]]), codes


def fit(docs: DataFrame, target_ids: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket, log of its probability in the target less that in all documents.

    The raw model counts every document; the target model counts those in ``target_ids`` (id), a
    bounded table. Each task sends one count per bucket, and the driver gets ``buckets`` rows.
    """

    @tidy
    def count(batches):
        totals = np.zeros((2, buckets), np.int64)
        for batch in batches:
            wanted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for owner, codes in grams(batch.column(0), buckets):
                totals[0] += np.bincount(codes, minlength=buckets)
                totals[1] += np.bincount(codes[wanted[owner]], minlength=buckets)
        used = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[0][used]), pa.array(totals[1][used])], names=["bucket", "raw", "target"])

    texts, ids = docs.select("doc_id", F.col("text").cast("string").alias("text")), target_ids.select("id")
    marked = texts.join(F.broadcast(ids), texts["doc_id"] == ids["id"], "left").select("text", F.col("id").isNotNull().alias("wanted"))
    sums = marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.full(buckets, SMOOTHING), np.full(buckets, SMOOTHING)
    for row in sums:
        raw[row.bucket] += row.raw
        target[row.bucket] += row.target
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, model: np.ndarray, seed: int = 10) -> DataFrame:
    """doc_id, n_grams, log_weight (the whole text's log ratio) and key (with seeded Gumbel noise)."""
    buckets = len(model)

    @tidy
    def score(batches):
        for batch in batches:
            total, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for owner, codes in grams(batch.column(1), buckets):
                total += np.bincount(owner, model[codes], batch.num_rows)
                size += np.bincount(owner, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(total)], names=["doc_id", "n_grams", "log_weight"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, n_grams long, log_weight double")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return scored.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))


def kth_key(keys: DataFrame, k: int, bands: int = BANDS) -> tuple[float, int]:
    """The k-th largest ``key``, and how many rows that have just this key are among the k largest.

    Rows are counted in equal bands between the smallest and the largest key; then the band of the k-th
    row is cut again, until it holds one key. The driver gets one row per band.
    """
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while low < high:
        width = (high - low) / bands
        band = F.least(F.floor((F.col("key") - low) / width), F.lit(bands - 1)) if width > 0 else (F.col("key") == high).cast("long")
        inside = keys.where(F.col("key").between(low, high)).groupBy(band.alias("band"))
        for row in inside.agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.col("band").desc()).collect():
            if row.rows >= k:
                low, high = row.low, row.high
                break
            k -= row.rows
    return low, k


def kth_id(ids: DataFrame, k: int) -> int | None:
    """The k-th smallest ``doc_id``, found twelve bits at a time; nulls are last."""
    known, inside = ids.where("doc_id IS NOT NULL"), F.lit(True)
    if known.count() < k:
        return None
    for shift in (52, 40, 28, 16, 4, 0):
        part = F.shiftright("doc_id", shift)
        for row in known.where(inside).groupBy(part.alias("part")).count().orderBy("part").collect():
            if row["count"] >= k:
                inside = part == row.part
                break
            k -= row["count"]
    return row.part


def top(keyed: DataFrame, k: int, bands: int = BANDS) -> DataFrame:
    """The column ``selected``: is the row among the k of largest key (ties: smaller doc_id, nulls last)?

    No task sorts or holds more than counts. Rows equal in key and doc_id are repeated rows and are
    selected alike, so there may be more than k rows by those of the last doc_id.
    """
    cutoff, wanted = kth_key(keyed, k, bands)
    above, tied = F.col("key") > F.lit(cutoff), F.col("key") == F.lit(cutoff)
    equal = keyed.where(tied)
    if equal.count() > wanted:
        last = kth_id(equal, wanted)
        if last is not None:
            tied = tied & F.coalesce(F.col("doc_id") <= F.lit(last), F.lit(False))
    return keyed.withColumn("selected", above | tied)


def resample(docs: DataFrame, target_ids: DataFrame, share: float = SHARE, seed: int = 10, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Select ``share`` of the documents, without replacement, with odds that follow target over raw.

    ``target_ids`` has the column doc_id of good documents; of these at most ``target_rows``, by the
    smallest seeded hashes, make the target model. Returns doc_id, n_grams, log_weight, key, selected
    for every row. Of equal (key, doc_id), that is of repeated rows, all are selected or none. A null, empty or wordless text has no n-grams and weight 0 (neither better nor
    worse than the corpus). Equal texts weigh equally; noise tells them apart by doc_id. Repeated
    rows get equal keys. A null doc_id has a key too. Without targets, every weight is near 0 and
    the choice is the noise's. An empty table gives an empty result.
    """
    bounded = target_ids.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct().orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id").limit(target_rows)
    model = fit(docs, cut(bounded), buckets)
    keyed = cut(weigh(docs, model, seed))
    k = round(share * keyed.count())
    return top(keyed, k) if k else keyed.withColumn("selected", F.lit(False))
