"""Where texts may repeat each other: content-chosen anchors, matched across the corpus.

A window is ``span`` tokens long. Each window has one anchor, the place in it whose ``gram`` tokens
have the smallest hash; equal windows have their anchors at the same place. So windows can only be
equal where anchors' grams are, and it is enough to bring together the passages around anchors
whose gram occurs more than once. All of this is exact: hashes only choose what is compared.

Every task first settles what it can among its own documents and sends each gram once, so that a gram
that a third of the corpus holds reaches its task no more than once from each sender.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, runs, text_buffer, tidy

NONE = np.uint64(2**64 - 1)
STEP = 0x9E3779B97F4A7C15
#: Odd multiplier of the rolling sums, and its inverse.
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 2**64)
BYTES = np.random.default_rng(5).integers(1, 2**64, 256, dtype=np.uint64)
#: Anchors that a task gathers before it sends them.
HELD = 1_500_000
#: Grams of so many occurrences are hot: their passages are dealt out by more of their context. A gram
#: must also be one HOT_SHARE-th of all anchors, so that the list that every task gets (8 bytes each)
#: has no more than HOT_SHARE grams; one below that is a small part of any task's share.
HOT, HOT_SHARE = 4096, 50_000
#: Tokens handled at once; longer documents are read in parts that overlap by a window.
PART = 1 << 20


@dataclass(frozen=True)
class Plan:
    span: int  # tokens in a window
    gram: int  # tokens whose hash chooses the anchor

    @property
    def left(self) -> int:
        """Tokens before an anchor that a window with this anchor can hold."""
        return self.span - self.gram

    @property
    def half(self) -> int:
        """Hot passages go to two places: windows with at most so many tokens before the anchor, and the others."""
        return self.left // 2


def pack(*arrays) -> bytes:
    """Arrays and byte strings in one compressed parcel; integers byte plane by byte plane, as high bytes repeat."""
    parts = [(a.dtype.str, a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) if isinstance(a, np.ndarray) else (None, a) for a in map(_flat, arrays)]
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(parts, protocol=5))


def _flat(a):
    return np.ascontiguousarray(a) if isinstance(a, np.ndarray) else a


def unpack(blob: bytes) -> list:
    out = []
    for kind, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)):
        if kind is None:
            out.append(raw)
        else:
            size = np.dtype(kind).itemsize
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel())
    return out


def scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_key(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 more bits of a gram's hash."""
    return (hashes % np.uint64(buckets)) << np.uint64(32) | (hashes // np.uint64(buckets)).astype(np.uint32).astype(np.uint64)


def is_hot(hashes: np.ndarray, buckets: int, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(hashes), bool)
    keys = gram_key(hashes, buckets)
    return hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys


def columns_hash(columns: list[np.ndarray]) -> np.ndarray:
    """The hash of a gram from its tokens, one array for each place; as gram_hashes gives it."""
    total = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        total = total * np.uint64(BASE) + c
    return scramble(total)


def bucket_of(doc_ids: np.ndarray, buckets: int) -> np.ndarray:
    return (scramble(doc_ids.astype(np.int64).view(np.uint64) + np.uint64(STEP)) % np.uint64(buckets)).astype(np.int64)


def gram_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive tokens, from sums over 1, 2, 4, ... tokens."""
    whole, covered, part, size = None, 0, tokens, 1
    while True:
        if n & size:
            if whole is None:
                whole, covered = part, size
            else:
                m = len(tokens) - size - covered + 1
                whole = part[:m] * np.uint64(pow(BASE, covered, 2**64)) + whole[size : size + m]
                covered += size
        if size * 2 > n:
            return scramble(whole)
        part = part[:-size] * np.uint64(pow(BASE, size, 2**64)) + part[size:]
        size *= 2


def sliding(values: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """``best`` (minimum or maximum) over each ``width`` consecutive values."""
    size, part = 1, values
    while size * 2 <= width:
        part = best(part[:-size], part[size:])
        size *= 2
    m = len(values) - width + 1
    return best(part[:m], part[width - size : width - size + m]) if size < width else part


def places(tokens: np.ndarray, offsets: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the documents that lie one after the other in ``tokens``: their places and hashes."""
    if len(tokens) < plan.span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = gram_hashes(tokens, plan.gram)
    room = np.repeat(offsets[1:], np.diff(offsets))[: len(hashes)] - np.arange(len(hashes))
    hashes[room < plan.gram] = NONE  # no gram runs into the next document
    width = plan.left + 1
    least = sliding(hashes, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    seen = sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    found = np.flatnonzero((seen == hashes) & (hashes != NONE))
    return found, hashes[found]


def document_parts(offsets: np.ndarray, plan: Plan, size: int = PART) -> Iterator[tuple[int, int, int, int]]:
    """(first document, last + 1, first token, last + 1) of parts that together hold every window whole."""
    for i, j in runs(offsets, size):
        if j - i > 1 or offsets[j] - offsets[i] <= 2 * size:
            yield i, j, int(offsets[i]), int(offsets[j])
        else:
            for a in range(int(offsets[i]), int(offsets[j]), size):
                yield i, j, a, min(a + size + plan.span - 1, int(offsets[j]))


def anchors_of(tokens: np.ndarray, offsets: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document index and place in the document of every anchor."""
    hashes, owners, spots = [], [], []
    for i, j, a, b in document_parts(offsets, plan):
        inner = np.clip(offsets[i : j + 1], a, b) - a
        found, values = places(tokens[a:b], inner, plan)
        owner = np.searchsorted(inner, found, side="right") - 1 + i if j - i > 1 else np.full(len(found), i)
        hashes.append(values)
        owners.append(owner)
        spots.append(found + a - offsets[owner])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners), np.concatenate(spots)


# Tokens ------------------------------------------------------------------------------------------


def byte_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTES[data], offsets


BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and where each document's words begin among them."""
    solid = ~BLANK[data]
    before, after = np.r_[False, solid[:-1]], np.r_[solid[1:], False]
    filled = offsets[:-1][np.diff(offsets) > 0]
    before[filled] = False
    after[filled[1:] - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word."""
    starts, ends, firsts = word_bounds(data, offsets)
    tokens = np.zeros(len(starts), np.uint64)
    for i, j in runs(firsts, 1 << 18):
        if firsts[i] == firsts[j]:
            continue
        a, b = starts[firsts[i] : firsts[j]], ends[firsts[i] : firsts[j]]
        low = a[0]
        piece = data[low : b[-1]]
        power = np.full(len(piece), BASE, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        back = np.full(len(piece), INVERSE, np.uint64)
        back[0] = 1
        back = np.cumprod(back)
        sums = np.r_[np.uint64(0), np.cumsum(BYTES[piece] * power)]
        tokens[firsts[i] : firsts[j]] = scramble((sums[b - low] - sums[a - low]) * back[a - low] + (b - a).astype(np.uint64))
    return tokens, firsts


# Exchanges ---------------------------------------------------------------------------------------


def batches_of(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Record batches of some megabytes."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes)) + 32
        if size > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=names)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=names)


PARCEL = "kind int, bucket long, parcel binary"
PARCEL_NAMES, PARCEL_TYPES = ["kind", "bucket", "parcel"], [pa.int32(), pa.int64(), pa.binary()]


def parcels(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    yield from batches_of(rows, PARCEL_NAMES, PARCEL_TYPES)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    """The parcels of one (kind, bucket) after the other, from sorted rows."""
    now, held = None, []
    for batch in batches:
        for kind, bucket, parcel in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (kind, bucket) != now:
                if held:
                    yield *now, held
                now, held = (kind, bucket), []
            held.append(parcel)
    if held:
        yield *now, held


def send(df: DataFrame, n: int) -> DataFrame:
    """Bring the parcels of a bucket together, in order; there is one of the ``n`` buckets of each kind to a partition."""
    return df.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).sortWithinPartitions("kind", "bucket")


def buckets_for(docs: DataFrame) -> int:
    """As many as partitions: the parcels of a stage are then no more than the blocks of its shuffle."""
    return partitions(docs.sparkSession, docs.select("doc_id"))


def deal(buckets: np.ndarray, count: int, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, columns of its rows), for each bucket that has rows; rows keep their order."""
    order = np.argsort(buckets, kind="stable")
    edges = np.searchsorted(buckets[order], np.arange(count + 1))
    for b in np.flatnonzero(np.diff(edges)):
        chosen = order[edges[b] : edges[b + 1]]
        yield int(b), *(c[chosen] for c in columns)


def by_document(doc_ids: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(doc_id, columns of its rows) for rows sorted by doc_id."""
    edges = np.flatnonzero(np.r_[True, doc_ids[1:] != doc_ids[:-1], True]) if len(doc_ids) else np.zeros(1, int)
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(doc_ids[a]), *(c[a:b] for c in columns)


def repeated_anchors(docs: DataFrame, plan: Plan, tokens: Callable) -> tuple[DataFrame, np.ndarray]:
    """(__doc, __spots), the places of each document's anchors whose gram occurs elsewhere; and the sorted keys of hot grams."""
    buckets = buckets_for(docs)

    def gather(hashes: np.ndarray, owners: np.ndarray, spots: np.ndarray):
        order = np.lexsort((spots, owners, hashes))
        hashes, owners, spots = hashes[order], owners[order], spots[order]
        fresh = np.r_[True, hashes[1:] != hashes[:-1]]
        many = ~fresh | np.r_[~fresh[1:], False]
        # The bucket and 32 bits more of the hash go along: the more buckets, the more bits in all.
        home = (hashes % np.uint64(buckets)).astype(np.int64)
        low = (hashes // np.uint64(buckets)).astype(np.uint32)
        times = np.minimum(np.diff(np.r_[np.flatnonzero(fresh), len(fresh)]), 65535).astype(np.uint16)
        for b, h, d, p, n in deal(home[fresh], buckets, low[fresh], owners[fresh], spots[fresh], times):
            o = np.lexsort((p, d))
            yield 0, b, pack(h[o], np.diff(d[o], prepend=0), p[o].astype(np.uint32), n[o])
        o = np.lexsort((spots[many], owners[many]))
        d, p = owners[many][o], spots[many][o]
        for b, d, p in deal(bucket_of(d, buckets), buckets, d, p):
            yield 1, b, pack(np.diff(d, prepend=0), p.astype(np.uint32))

    @tidy
    def scan(batches):
        held, size = [], 0

        def settle():
            return gather(*(np.concatenate(c) for c in zip(*held)))

        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in runs(offsets, 1 << 23):
                coded, firsts = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hashes, owners, spots = anchors_of(coded, firsts, plan)
                if len(hashes):
                    held.append((hashes, ids[i:j][owners], spots))
                    size += len(hashes)
                if size > HELD:
                    yield from parcels(settle())
                    held, size = [], 0
        if held:
            yield from parcels(settle())

    @tidy
    def meet(batches):
        def found():
            for kind, bucket, blobs in by_bucket(batches):
                if kind == 1:
                    yield from ((0, bucket, blob) for blob in blobs)
                    continue
                seen = [unpack(b) for b in blobs]
                hashes = np.concatenate([x[0] for x in seen])
                owners, spots = np.concatenate([np.cumsum(x[1]) for x in seen]), np.concatenate([x[2] for x in seen])
                order = np.argsort(hashes, kind="stable")
                h = hashes[order]
                again = h[1:] == h[:-1]
                chosen = order[np.r_[again, False] | np.r_[False, again]]
                opens = np.flatnonzero(np.r_[True, ~again]) if len(h) else np.zeros(0, np.int64)
                totals = np.add.reduceat(np.concatenate([x[3] for x in seen]).astype(np.int64)[order], opens) if len(h) else opens
                many = totals >= HOT
                keys = np.uint64(bucket) << np.uint64(32) | h[opens[many]].astype(np.uint64)
                yield 1, bucket, pack(keys, totals[many], totals.sum(keepdims=True))
                d, p = owners[chosen], spots[chosen]
                o = np.lexsort((p, d))
                d, p = d[o], p[o]
                for b, dd, pp in deal(bucket_of(d, buckets), buckets, d, p):
                    yield 0, b, pack(np.diff(dd, prepend=0), pp)

        yield from parcels(found())

    @tidy
    def regroup(batches):
        def rows():
            for kind, _, blobs in by_bucket(batches):
                seen = [unpack(b) for b in blobs]
                if kind == 1:
                    for keys, times, total in seen:
                        yield from ((None, None, k, t) for k, t in zip(keys.view(np.int64).tolist(), times.tolist()))
                        yield None, None, None, int(total[0])
                    continue
                d, p = np.concatenate([np.cumsum(x[0]) for x in seen]), np.concatenate([x[1] for x in seen])
                o = np.lexsort((p, d))
                d, p = d[o], p[o]
                fresh = np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1])]
                for doc, spots in by_document(d[fresh], p[fresh]):
                    yield doc, spots.astype("<u4").tobytes(), None, None

        yield from batches_of(rows(), ["__doc", "__spots", "__gram", "__times"], [pa.int64(), pa.binary(), pa.int64(), pa.int64()])

    sent = docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(scan, PARCEL)
    found = cut(send(send(sent, buckets).mapInArrow(meet, PARCEL), buckets).mapInArrow(regroup, "__doc long, __spots binary, __gram long, __times long"))
    counted = found.where("__doc IS NULL")
    every = counted.where("__gram IS NULL").agg(F.sum("__times")).first()[0] or 0
    listed = counted.where((F.col("__gram").isNotNull()) & (F.col("__times") >= max(HOT, every // HOT_SHARE))).select("__gram").collect()
    hot = np.array([r[0] for r in listed], np.int64).view(np.uint64)
    return found.where("__doc IS NOT NULL").select("__doc", "__spots"), np.sort(hot)


def merge_spans(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of the spans of each owner, as sorted spans that do not touch."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    index = np.cumsum(np.r_[0, owner[1:] != owner[:-1]])
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(index * wide + end)
    fresh = np.r_[True, index[1:] * wide + start[1:] > reach[:-1]]
    at = np.flatnonzero(fresh)
    last = np.r_[at[1:], len(owner)] - 1
    return owner[at], start[at], reach[last] - index[at] * wide


def span_parcels(owner: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int, kind: int) -> Iterator[tuple[int, int, bytes]]:
    owner, start, end = merge_spans(owner, start, end)
    for b, d, s, e in deal(bucket_of(owner, buckets), buckets, owner, start, end):
        yield kind, b, pack(np.diff(d, prepend=0), s.astype(np.uint32), (e - s).astype(np.uint32))


@tidy
def collect_spans(batches):
    """(doc, spans): the merged spans of each document, as pairs of little-endian unsigned integers."""

    def rows():
        for _, _, blobs in by_bucket(batches):
            seen = [unpack(b) for b in blobs]
            d = np.concatenate([np.cumsum(x[0]) for x in seen])
            s = np.concatenate([x[1] for x in seen]).astype(np.int64)
            e = s + np.concatenate([x[2] for x in seen])
            for doc, s, e in by_document(*merge_spans(d, s, e)):
                yield doc, np.stack([s, e], axis=1).astype("<u4").tobytes()

    yield from batches_of(rows(), ["__owner", "__spans"], [pa.int64(), pa.binary()])


def full_windows(left: np.ndarray, right: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest distance from window start to anchor, given the tokens on either side."""
    return np.maximum(0, plan.span - right), np.minimum(plan.left, left)


def repeated_spans(docs: DataFrame, plan: Plan, tokens: Callable, send_out: Callable, settle: Callable) -> DataFrame:
    """``docs`` (doc_id, text) with the column ``__spans`` of tokens in windows that are repeats.

    ``send_out`` turns the passages of a task's documents into parcels of kind 0 for their grams'
    buckets, and into spans of kind 1 that it could settle itself; ``settle`` turns the parcels of a
    gram bucket into spans. A struct column ``__row``, if there, is carried along. The texts are
    shuffled once: both joins read the same exchange, so both keep the same columns.
    """
    buckets = buckets_for(docs)
    carried = ["__row"] if "__row" in docs.columns else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    anchored, hot = repeated_anchors(docs, plan, tokens)
    passages = docs.join(anchored.hint("shuffle_hash"), docs["doc_id"] == anchored["__doc"], "left").select("doc_id", "text", "__spots", *carried)

    @tidy
    def out(batches):
        yield from parcels(send_out(batches, plan, buckets, hot))

    @tidy
    def meet(batches):
        def found():
            for kind, bucket, blobs in by_bucket(batches):
                if kind == 1:
                    yield from ((0, bucket, blob) for blob in blobs)
                else:
                    yield from span_parcels(*settle(blobs, plan), buckets, 0)

        yield from parcels(found())

    spans = send(send(passages.mapInArrow(out, PARCEL), buckets).mapInArrow(meet, PARCEL), buckets).mapInArrow(collect_spans, "__owner long, __spans binary")
    return docs.join(spans.hint("shuffle_hash"), docs["doc_id"] == spans["__owner"], "left").select("doc_id", "text", "__spans", *carried)


def batch_spots(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, index of the document in the batch and place of every anchor that came with a batch."""
    raw, offsets = text_buffer(batch.column(2))
    counts = np.diff(offsets) // 4
    owners = np.repeat(np.arange(batch.num_rows), counts)
    spots = np.frombuffer(raw.tobytes(), "<u4").astype(np.int64)
    ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, owners, spots
