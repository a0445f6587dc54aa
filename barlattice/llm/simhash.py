"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, merge_labels, partitions, split_heavy, spread, tidy, trees

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Children of a node of the index.
FANOUT = 8
#: Rows of a bucket that one task indexes; larger buckets are dealt out as pairs of blocks.
BUCKET = 50_000
ZERO = np.uint64(0)


def shingle_bits(words: list[bytes], n: int, seed: int) -> tuple[np.ndarray, int]:
    """How often each of the 64 bits is set over the hashes of all word n-grams, and their number."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < n:
        hashes = [digest(joined, seed)]
    else:
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())]
    values = np.array(hashes, dtype="<u8")
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64), len(values)


def fingerprint(text: bytes, n: int = SHINGLE, seed: int = SEED, chunk: int = 1 << 22) -> int:
    """The 64-bit fingerprint of a whole text; long texts are read in parts that overlap by n - 1 words.

    ASCII white space parts words and only A-Z are lower-cased, as ``bytes`` methods do.
    """
    if len(text) <= chunk:
        words = text.lower().split()
        if not words:
            return 0
        bits, total = shingle_bits(words, n, seed)
    else:
        bits, total, kept, at, few = np.zeros(64, np.int64), 0, [], 0, True
        while at < len(text):
            end = min(at + chunk, len(text))
            while end < len(text) and text[end] not in b" \t\n\v\f\r":
                end += 1
            words = kept + text[at:end].lower().split()
            if len(words) >= n:
                more, count = shingle_bits(words, n, seed)
                bits, total, few = bits + more, total + count, False
                words = words[len(words) - n + 1 :] if n > 1 else []
            kept, at = words, end
        if few:
            if not kept:
                return 0
            bits, total = shingle_bits(kept, n, seed)
    return int.from_bytes(np.packbits(2 * bits > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, n: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fingerprint (as a signed long). Null, empty and wordless texts have fingerprint 0."""

    @tidy
    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            marks = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", n, seed) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(marks, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit pattern in the reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """A forest over fingerprints sorted by (bucket, Gray rank), one tree per bucket.

    A node stands for FANOUT consecutive children. What all fingerprints below it share is a mask and
    a pattern; a child keeps only the bits that its parent does not have already. A search adds up,
    from the root down, the differences in the bits of each node and drops a whole group as soon as
    the sum passes the distance; at the leaves the sum is the Hamming distance itself.
    """

    def __init__(self, buckets: np.ndarray, values: np.ndarray):
        n = len(values)
        mask, pattern = np.full(n, ~ZERO), values.copy()
        first, end, owner = np.arange(n), np.arange(1, n + 1), buckets
        levels = [(mask, pattern, end, np.arange(n), np.zeros(n, np.int64))]
        while True:
            opens = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[opens, len(owner)])
            if (sizes == 1).all() and len(levels) > 1:
                break
            place = np.arange(len(owner)) - np.repeat(opens, sizes)
            begin = np.flatnonzero(place % FANOUT == 0)
            count = np.diff(np.r_[begin, len(owner)])
            spot = np.repeat(pattern[begin], count)
            differ = np.bitwise_or.reduceat((pattern ^ spot) | ~mask, begin)
            up_mask = ~differ
            up_pattern = pattern[begin] & up_mask
            parent = np.repeat(np.arange(len(begin)), count)
            levels[-1] = (mask & ~up_mask[parent], pattern, *levels[-1][2:])  # the shared bits move up
            end = end[begin + count - 1]
            mask, pattern, owner = up_mask, up_pattern, owner[begin]
            levels.append((mask, pattern, end, begin, count))
        self.values, self.levels, self.buckets, self.owner = values, levels, buckets, owner

    def search(self, values: np.ndarray, buckets: np.ndarray, distance: int, after: np.ndarray | None = None, chunk: int = 2048):
        """(query, leaf) index pairs of the same bucket within the distance, in chunks of queries; only leaves past ``after``."""
        after = np.full(len(values), -1) if after is None else after
        top = len(self.levels) - 1
        for a in range(0, len(values) if len(self.values) else 0, chunk):
            query = np.arange(a, min(a + chunk, len(values)))
            node = np.minimum(np.searchsorted(self.owner, buckets[query]), len(self.owner) - 1)
            known = self.owner[node] == buckets[query]
            query, node = query[known], node[known]
            mask, pattern, end, *_ = self.levels[top]
            gone = np.bitwise_count((values[query] ^ pattern[node]) & mask[node]).astype(np.int16)
            keep = (gone <= distance) & (end[node] > after[query] + 1)
            query, node, gone = query[keep], node[keep], gone[keep]
            for level in range(top, 0, -1):
                _, _, _, begin, count = self.levels[level]
                each = count[node]
                query, gone = np.repeat(query, each), np.repeat(gone, each)
                node = spread(begin[node], each)
                mask, pattern, end, *_ = self.levels[level - 1]
                gone = gone + np.bitwise_count((values[query] ^ pattern[node]) & mask[node])
                keep = (gone <= distance) & (end[node] > after[query] + 1)
                query, node, gone = query[keep], node[keep], gone[keep]
            yield query, node

    def pairs(self, distance: int, chunk: int = 2048):
        """Index pairs (i < j) of the same bucket within the distance, in chunks."""
        return self.search(self.values, self.buckets, distance, np.arange(len(self.values)), chunk)


def block_layout(rows: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(rotation, bits that must agree): fingerprints within the distance agree in one of these.

    64 bits in distance + 1 blocks leave one block unhurt. The more rows, the more blocks are cut and
    the more of them must agree, so that buckets stay small.
    """
    blocks = distance + 1 if rows <= 8_000_000 else distance + 2 if rows <= 20_000_000_000 else distance + 3
    from itertools import combinations

    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    spans = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    return [(i, sum(spans[b] for b in chosen)) for i, chosen in enumerate(combinations(range(blocks), blocks - distance))]


def links(marks: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) of fingerprints that connect all those within the distance of each other.

    ``marks`` has the distinct fingerprints ``fp``. Within a bucket, the pairs found are joined to sets
    at once and each set leaves as a tree, so edges never outnumber the rows of the buckets.
    """
    layout = block_layout(marks.count(), distance)
    signed = [(i, m - (1 << 64) if m >> 63 else m) for i, m in layout]
    dealt = marks.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("way"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("shared")) for i, m in signed])).alias("__k"))
    dealt = dealt.select("fp", F.col("__k.way").alias("way"), F.col("__k.shared").alias("shared"))
    dealt = split_heavy(dealt, ["way", "shared"], "fp", bucket)

    @tidy
    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        fp, way, shared, lo, hi = (table[c].to_numpy() for c in ("fp", "way", "shared", "lo", "hi"))
        fp = fp.view(np.uint64)
        order = np.lexsort((gray_rank(fp), hi, lo, shared, way))
        fp, way, shared, lo, hi = (x[order] for x in (fp, way, shared, lo, hi))
        fresh = np.r_[True, (way[1:] != way[:-1]) | (shared[1:] != shared[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
        labels = np.arange(len(fp))
        for a, b in GrayIndex(np.cumsum(fresh) - 1, fp).pairs(distance):
            labels = merge_labels(labels, a, b)
        child, parent = trees(labels)
        yield pa.RecordBatch.from_arrays([pa.array(fp[child].view(np.int64)), pa.array(fp[parent].view(np.int64))], names=["a", "b"])

    spread_out = dealt.repartition(partitions(marks.sparkSession) * 2, "way", "shared", "lo", "hi")
    return spread_out.select("fp", "way", "shared", "lo", "hi").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents link when their fingerprints differ in at most ``distance`` bits; component_id is the
    smallest doc_id that links reach. Equal fingerprints, those of empty and null texts (0) among
    them, are one node, so copies are never paired with each other. A null doc_id links as others do
    but is never a component's name; a component of nulls alone has a null component_id. Repeated rows
    give repeated rows, an empty table an empty result.
    """
    marks = cut(fingerprints(docs, n, seed))
    nodes = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("__least")))
    joined = components(links(nodes.select("fp"), distance))
    placed = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "__least", F.coalesce("component", "fp").alias("__group"))
    names = placed.groupBy(F.col("__group").alias("__named")).agg(F.min("__least").alias("component_id"))
    named = placed.join(names, F.col("__group") == F.col("__named")).select(F.col("fp").alias("__fp"), "component_id")
    out = marks.join(named, marks["fp"] == named["__fp"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
