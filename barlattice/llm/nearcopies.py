"""SimHash near-dedup at a shingle similarity: fingerprints in Gray order propose pairs, the whole shingle sets decide.

Two sets of similarity 0.8 have SimHash fingerprints that differ in about 10 of 64 bits and seldom in
more than 22. No choice of agreeing bits of 64 is selective at such a distance, so a document has a
long SimHash, of as many words as it takes: each of its tables is some bits of it, and documents that
agree in all bits of a table are in one bucket. Buckets are ordered and searched by a word of their own.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, components, cut, partitions, salted, tidy
from .simhash import GrayIndex, gray_rank

#: Words of a shingle, and the similarity from which two documents are near copies.
SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Bits in which fingerprints may differ: at similarity 0.8 each differs with probability 0.152, more than 22 with 5e-5.
DISTANCE = 22
#: Share of bits in which two sets of similarity 0.8 differ, at most (the sizes 13 and 14); where the smaller set has 4 shingles, the other.
#: A pair's sets are read if its long SimHashes differ in no more than that and CHECKED standard deviations.
DIFFERS, DIFFERS_AT_4, CHECKED = 0.1612, 0.1875, 5
#: Share of bits in which similarity 0.8 agrees, and the probability with which it shares no bucket.
AGREED, MISSED = 1 - math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi, 1e-4
#: Strangers of a bucket, at most, as a power of two; bits of a bucket at least.
STRANGERS, LEAST_BITS = 4, 8
#: Buckets of up to so many nodes give all their pairs at once; larger ones first only neighbours in Gray order and a pivot.
SMALL = 32
#: Tables in which large buckets propose pairs; in the others they are searched only.
PROPOSING = 12
#: Nodes of a bucket that one task orders; larger buckets are dealt out.
BUCKET = 50_000
#: Nodes of a family of candidates in a block; a task has the sets of two blocks at most.
BLOCK = 256
#: Nodes of a large bucket that come into one task with their sets.
HELD = 1024


def shingles(text: bytes, n: int = SHINGLE, chunk: int = 1 << 22) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a text of fewer words is one shingle, one of none has none."""
    digest, found, kept, at, few = xxhash.xxh64_intdigest, [], [], 0, True
    while at < len(text):
        end = min(at + chunk, len(text))
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        words = kept + text[at:end].lower().split()
        if len(words) >= n:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.r_[0, ends[:-1] + 1]
            found.append(np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())], np.uint64)))
            words, few = words[len(words) - n + 1 :], False
        kept, at = words, end
    if few:
        return np.array([digest(b" ".join(kept), SEED)] if kept else [], np.uint64)
    return np.unique(np.concatenate(found))


def layout(rows: int) -> tuple[int, int]:
    """Bits of a bucket and number of tables for so many documents: the more there are, the more bits, so that strangers stay few."""
    bits = max(LEAST_BITS, (max(rows, 1) - 1).bit_length() - STRANGERS)
    return bits, math.ceil(math.log(MISSED) / math.log1p(-(AGREED**bits)))


@functools.lru_cache
def mixers(count: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**64, (2, count), dtype=np.uint64) | np.array([[1], [0]], np.uint64)


def long_simhash(hashes: np.ndarray, count: int, chunk: int = 255) -> np.ndarray:
    """``count`` words of SimHash: every word mixes the hashes in its own way; a bit is 1 if set in over half of them."""
    odd, other = mixers(count)
    bits = np.zeros(64 * count, np.int64)
    for a in range(0, len(hashes), chunk):  # at most 255, so that bytes can count
        x = (hashes[a : a + chunk, None] ^ other) * odd
        x ^= x >> np.uint64(32)
        bits += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")


def buckets(words: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket in each table, a number from 0 up, of each row of words: the table and its bits of the words, in order."""
    out = np.tile(np.arange(tables, dtype=np.int64) << bits, (len(words), 1))
    for a in range(0, len(words), 1024):
        own = np.unpackbits(np.ascontiguousarray(words[a : a + 1024]).view(np.uint8), axis=1, bitorder="little")[:, : bits * tables].reshape(-1, tables, bits)
        for i in range(bits):
            out[a : a + 1024] |= own[:, :, i].astype(np.int64) << i
    return out


def exact_buckets(hashes: np.ndarray) -> list[int]:
    """Further buckets (negative) of sets of 4 and 5 shingles, whose bits agree less often: those of 5 have one for each 4 of theirs."""
    if len(hashes) not in (4, 5):
        return []
    return [xxhash.xxh64_intdigest(np.sort(np.array(x, np.uint64)).tobytes(), SEED) % 2**63 - 2**63 for x in itertools.combinations(hashes.tolist(), 4)]


def set_fingerprint(hashes: np.ndarray, chunk: int = 1 << 16) -> int:
    """SimHash of a set of shingles: a bit is 1 if set in over half the hashes."""
    bits = np.zeros(64, np.int64)
    for a in range(0, len(hashes), chunk):
        bits += np.unpackbits(hashes[a : a + chunk].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes), bitorder="little").tobytes(), "little")


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def close(fp: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """May nodes i and j be near copies, by their fingerprints and by the sizes of their sets?"""
    return (np.bitwise_count(fp[i] ^ fp[j]) <= DISTANCE) & (np.minimum(size[i], size[j]) >= SIMILARITY * np.maximum(size[i], size[j]) - 1e-9)


def own_key(salt: int) -> Column:
    """The key of a row without a doc_id: a hash of its text and ``salt``."""
    return F.xxhash64(F.col("text").cast("string"), F.lit(salt))


def free_salt(docs: DataFrame) -> int:
    """The first salt with which no row without a doc_id has a key that is a doc_id."""
    nameless = docs.where("doc_id IS NULL")
    if nameless.isEmpty():
        return 0
    for salt in itertools.count():
        keys = nameless.select(own_key(salt).alias("__key")).distinct()
        if keys.join(docs.select(F.col("doc_id").cast("long").alias("__id")), F.col("__key") == F.col("__id"), "left_semi").isEmpty():
            return salt


def keyed(docs: DataFrame, salt: int) -> DataFrame:
    """``key``: the doc_id, or where it is null a hash of the text that is no doc_id; and the text."""
    doc = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc, own_key(salt)).alias("key"), doc.isNotNull().alias("named"), F.col("text").cast("string").alias("text"))


def sketches(keys: DataFrame, count: int) -> DataFrame:
    """Of every row of ``keyed``: key, named, a hash of the whole shingle set, its size, fingerprint, long SimHash and exact buckets.

    Sets of under four shingles are near copies only of themselves and have neither SimHash nor buckets.
    """

    @tidy
    def run(batches):
        for batch in batches:
            marks, sizes, prints, words, exact = [], [], [], [], []
            for x in batch.column(2):
                found = shingles(x.as_buffer().to_pybytes() if x.is_valid else b"")
                marks.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                prints.append(set_fingerprint(found))
                words.append(long_simhash(found, count).tobytes() if len(found) >= 4 else None)
                exact.append(exact_buckets(found))
            signed = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (marks, prints))
            columns = [batch.column(0), batch.column(1), next(signed), pa.array(sizes, pa.int32()), next(signed), pa.array(words, pa.binary()), pa.array(exact, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "named", "mark", "size", "fp", "words", "exact"])

    return keys.mapInArrow(run, "key long, named boolean, mark long, size int, fp long, words binary, exact array<long>")


def words_of(column: pa.Array) -> np.ndarray:
    """The long SimHashes of a column without nulls, a row each."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), "<u8").reshape(len(column), -1)


def agree(words: np.ndarray, i: np.ndarray, j: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
    """May rows i and j be near copies, by all bits of their long SimHashes? ``least``: the size of the smaller set of each pair."""
    bits = 64 * words.shape[1]
    most, at_4 = (share * bits + CHECKED * math.sqrt(share * (1 - share) * bits) for share in (DIFFERS, DIFFERS_AT_4))
    differ = np.zeros(len(i), np.int64)
    for k in range(words.shape[1]):
        differ += np.bitwise_count(words[i, k] ^ words[j, k])
    return differ <= (most if least is None else np.where(least == 4, at_4, most))


def bands_of(batch: pa.RecordBatch, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """The row (by its place in the batch) and the key of each bucket of each row."""
    there = np.arange(batch.num_rows)
    more = np.repeat(there, batch["exact"].value_lengths().to_numpy())
    return np.concatenate([np.repeat(there, tables), more]), np.concatenate([buckets(words_of(batch["words"]), bits, tables).ravel(), batch["exact"].flatten().to_numpy()])


def dealt_out(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """node, size, fp and band: a row for each bucket of each node."""

    @tidy
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                rows, band = bands_of(part, bits, tables)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(part[c].take(at) for c in ("node", "size", "fp")), pa.array(band)], names=["node", "size", "fp", "band"])

    return nodes.select("node", "size", "fp", "words", "exact").mapInArrow(run, "node long, size int, fp long, band long")


def heavy_buckets(nodes: DataFrame, dealt: DataFrame, bucket: int, bits: int, tables: int) -> DataFrame | None:
    """__band, held and pivot of the buckets of over ``bucket`` nodes, if there are any.

    Such a bucket has more than its share of the nodes of some task; only buckets that have are counted.
    """
    total = nodes.count()
    if total <= bucket:
        return None

    @tidy
    def some(batches):
        bands, own = [], 0
        for batch in batches:
            bands.append(bands_of(batch, bits, tables)[1])
            own += batch.num_rows
        if own:
            band, count = np.unique(np.concatenate(bands), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(band[count > bucket * own / total])], names=["__band"])

    maybe = cut(nodes.select("words", "exact").mapInArrow(some, "__band long").distinct())
    many = maybe.limit(BROADCAST_ROWS + 1).count()
    if not many:
        return None
    pivot = F.min(F.struct(F.xxhash64("node", "band").alias("turn"), "node", "fp", "size")).alias("pivot")
    own = dealt.join(F.broadcast(maybe) if many <= BROADCAST_ROWS else maybe, F.col("band") == F.col("__band"), "left_semi")
    heavy = cut(own.groupBy("band").agg(F.count(F.lit(1)).alias("held"), pivot).where(F.col("held") > bucket).select(F.col("band").alias("__band"), "held", "pivot"))
    return None if heavy.isEmpty() else heavy


def whole_table(batches) -> pa.Table | None:
    parts = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(parts) if parts else None


def proposals(nodes: DataFrame, small: int, bucket: int, parts: int, bits: int, tables: int) -> DataFrame:
    """(a, b, bucket): pairs to be compared (bucket null), and the nodes b of large buckets with a pivot a each.

    Small buckets give all pairs that ``close`` lets through. In larger ones of the first tables a node is proposed
    with the one before it in Gray order and with the pivot; all larger ones are searched. The order of each bucket is turned by its key, so
    that every bucket has another order and another pivot. A bucket of over ``bucket`` nodes is dealt out.
    """
    nodes = nodes.where("words IS NOT NULL")
    dealt = dealt_out(nodes, bits, tables)
    heavy = heavy_buckets(nodes, dealt, bucket, bits, tables)
    if heavy is not None:
        few = heavy.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        dealt = dealt.join(F.broadcast(heavy) if few else heavy, F.col("band") == F.col("__band"), "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("held") / bucket)), F.lit(0)))
        dealt = dealt.select("node", "size", "fp", "band", "block", F.col("pivot.node").alias("pnode"), F.col("pivot.fp").alias("pfp"), F.col("pivot.size").alias("psize"))
    else:
        dealt = dealt.select("*", F.lit(0).cast("long").alias("block"), F.lit(None).cast("long").alias("pnode"), F.lit(None).cast("long").alias("pfp"), F.lit(None).cast("int").alias("psize"))

    @tidy
    def run(batches):
        table = whole_table(batches)
        if table is None:
            return
        node, size, fp, band, block = (table[c].to_numpy() for c in ("node", "size", "fp", "band", "block"))
        given = table["pnode"].is_valid().to_numpy()
        lead = [table[c].fill_null(0).to_numpy() for c in ("pnode", "pfp", "psize")]
        fp = fp.view(np.uint64)
        order = np.lexsort((node, gray_rank(fp ^ (band.view(np.uint64) + np.uint64(1)) * mixers(1)[0]), block, band))
        node, size, fp, band, block, given, *lead = (x[order] for x in (node, size, fp, band, block, given, *lead))
        first = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (block[1:] != block[:-1])])
        count = np.diff(np.r_[first, len(band)])

        def pairs(i, j):
            fits = close(fp, size, i, j)
            return pa.RecordBatch.from_arrays([pa.array(node[i[fits]]), pa.array(node[j[fits]]), pa.nulls(int(fits.sum()), pa.int64())], names=["a", "b", "bucket"])

        little = (count <= small) & ~given[first]
        few, held = first[little], count[little]
        for gap in range(1, small):
            for at in range(small - gap):
                i = few[held > at + gap] + at
                if len(i):
                    yield pairs(i, i + gap)
        for begin, n in zip(first[~little].tolist(), count[~little].tolist()):
            i = np.arange(begin, begin + n)
            early = band[begin] < PROPOSING << bits
            if early:
                yield pairs(i[:-1], i[1:])
            if given[begin] and early:
                p, q, r = (np.concatenate([x[begin : begin + 1], y[i]]) for x, y in zip(lead, (node, fp.view(np.int64), size)))
                fits = close(q.view(np.uint64), r, np.zeros(n, int), np.arange(1, n + 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(fits.sum()), p[0])), pa.array(node[i[fits]]), pa.nulls(int(fits.sum()), pa.int64())], names=["a", "b", "bucket"])
            elif early:
                yield pairs(np.full(n - 1, begin), i[1:])
            main = lead[0][begin] if given[begin] else node[begin]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, main)), pa.array(node[i]), pa.array(band[i])], names=["a", "b", "bucket"])

    return dealt.repartition(parts, "band", "block").mapInArrow(run, "a long, b long, bucket long")


def shingle_sets(keys: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, hashes): the whole shingle sets of the nodes in ``ids`` (node), a little-endian number for each shingle."""

    @tidy
    def read(batches):
        seen: set[int] = set()  # repeated rows give one set to a task
        for batch in batches:
            fresh = [k not in seen and not seen.add(k) for k in batch.column(0).to_pylist()]
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                blobs = pa.array([shingles(x.as_buffer().to_pybytes() if x.is_valid else b"").tobytes() for x in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), blobs], names=["id", "hashes"])

    ids = cut(ids.select(F.col("node").alias("__node")).distinct())
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    chosen = keys.select("key", "text").join(F.broadcast(ids) if few else ids, F.col("key") == F.col("__node"), "left_semi")
    return chosen.mapInArrow(read, "id long, hashes binary")


def searched(keys: DataFrame, rows: DataFrame, parts: int, bits: int, tables: int, block: int = HELD) -> DataFrame:
    """Links (a, b) between different components in large buckets, one node outside the bucket's main component.

    ``rows`` has bucket, node, size, fp, words, c (component), main (the bucket's) and held (its size).
    The nodes of a bucket, in blocks, make a Gray index each, and those outside the main component are
    its queries; whole groups unlike a query are left at the upper nodes. A pair counts where it is found
    in the first table that both share, and in exact buckets. A first search tells which nodes are in such
    a pair in their bucket; only their sets come, once for each node and block, and are compared there.
    """
    blocks = F.ceil(F.col("held") / block).cast("int")
    names = ["bucket", "node", "size", "fp", "words", "c", "main"]

    def blocked(rows: DataFrame, sets: DataFrame | None) -> DataFrame:
        inner = rows.select(*names, F.lit(False).alias("asks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
        asking = rows.where("c <> main").select(*names, F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
        dealt = inner.union(asking)
        dealt = dealt if sets is None else dealt.join(sets, F.col("node") == F.col("id")).drop("id")
        return dealt.repartition(parts, "bucket", "block").sortWithinPartitions("bucket", "block")

    def found(table: pa.Table):
        """Pairs (asking, inside) of one block of one bucket that may be near copies and are not linked yet, in parts."""
        band, node, size, fp, c, main, asks = (table[x].to_numpy(zero_copy_only=False) for x in ("bucket", "node", "size", "fp", "c", "main", "asks"))
        words = words_of(table["words"].combine_chunks())
        all_buckets = buckets(words, bits, tables)
        fp, asks = fp.view(np.uint64), asks.astype(bool)
        inside, outside = np.flatnonzero(~asks), np.flatnonzero(asks)
        inside = inside[np.argsort(gray_rank(fp[inside]), kind="stable")]
        if not len(inside) or not len(outside):
            return
        index = GrayIndex(np.zeros(len(inside), np.int64), fp[inside])
        for q, leaf in index.search(fp[outside], np.zeros(len(outside), np.int64), DISTANCE, chunk=64):
            for at in range(0, len(q), 8192):
                i, j = outside[q[at : at + 8192]], inside[leaf[at : at + 8192]]
                fits = (c[i] != c[j]) & ((node[i] < node[j]) | (c[j] == main[j])) & close(fp, size, i, j)
                i, j = i[fits], j[fits]
                fits = agree(words, i, j, np.minimum(size[i], size[j]))
                i, j = i[fits], j[fits]
                first = (all_buckets[i] == all_buckets[j]).argmax(axis=1)
                here = (band[i] < 0) | (all_buckets[i, first] == band[i])
                yield i[here], j[here]

    def fitting(table: pa.Table):
        """The nodes of one block that are in such a pair: no others need their sets."""
        node, at = table["node"].to_numpy(), set()
        for i, j in found(table):
            at.update(i.tolist(), j.tolist())
        fits = np.unique(node[list(at)]) if at else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fits), table["bucket"][0].as_py(), np.int64)), pa.array(fits)], names=["__bucket", "__node"])

    def compare(table: pa.Table):
        """The links of one block of one bucket."""
        node, size, c = (table[x].to_numpy() for x in ("node", "size", "c"))
        blobs = table["hashes"].combine_chunks()
        held: dict[int, set] = {}
        up: dict[int, int] = {}
        a, b = [], []

        def own(i: int) -> set:
            if node[i] not in held:
                held[node[i]] = set(np.frombuffer(blobs[i].as_buffer(), np.uint64).tolist())
            return held[node[i]]

        for i, j in found(table):
            for x, y in zip(i.tolist(), j.tolist()):
                one, two = top(up, int(c[x])), top(up, int(c[y]))
                if one == two:
                    continue
                both = len(own(x) & own(y))
                if both >= SIMILARITY * (size[x] + size[y] - both) - 1e-9:
                    up[max(one, two)] = min(one, two)
                    a.append(node[x])
                    b.append(node[y])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def each(judge):
        @tidy
        def run(batches):
            held: list[pa.RecordBatch] = []
            now = None
            for batch in batches:
                keys = [batch.column(x).to_numpy() for x in ("bucket", "block")]
                edges = [0, *(np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1).tolist(), batch.num_rows] if batch.num_rows else []
                for x, y in zip(edges[:-1], edges[1:]):
                    if (keys[0][x], keys[1][x]) != now:
                        if held:
                            yield from judge(pa.Table.from_batches(held))
                        now, held = (keys[0][x], keys[1][x]), []
                    held.append(batch.slice(x, y - x))
            if held:
                yield from judge(pa.Table.from_batches(held))

        return run

    left = cut(blocked(rows, None).mapInArrow(each(fitting), "__bucket long, __node long").distinct())
    rows = cut(rows.join(left, (F.col("bucket") == F.col("__bucket")) & (F.col("node") == F.col("__node")), "left_semi"))
    return cut(blocked(rows, shingle_sets(keys, rows.select("node"))).mapInArrow(each(compare), "a long, b long"))


def top(up: dict[int, int], x: int) -> int:
    """The name of x's set, where ``up`` leads from a name to a smaller one."""
    while up.get(x, x) != x:
        x = up[x]
    return x


def families(pairs: DataFrame) -> DataFrame:
    """(node, family): the least node within two steps over the pairs (one, two); so most of those that meet often have one name."""
    both = pairs.union(pairs.select("two", "one")).toDF("a", "b")
    near = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))).toDF("node", "least")
    return cut(salted(both, near, "b", "node", "a").groupBy(F.col("a").alias("node")).agg(F.min("least").alias("family")))


def verified(keys: DataFrame, nodes: DataFrame, pairs: DataFrame, parts: int) -> DataFrame:
    """Links (a, b) that join the nodes which the pairs of similar whole shingle sets among ``pairs`` join, as flat trees.

    Only pairs whose long SimHashes agree are compared. A pair goes to a pair of blocks of its family, and a
    node's set goes once to each of those where it has a pair: not with each pair.
    """
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("one"), F.greatest("a", "b").alias("two")).distinct()
    for side in ("one", "two"):
        pairs = pairs.join(nodes.select(F.col("node").alias(f"__{side}"), F.col("size").alias(f"size_{side}"), F.col("words").alias(f"words_{side}")), F.col(side) == F.col(f"__{side}"))

    @tidy
    def agreeing(batches):
        for batch in batches:
            n = np.arange(batch.num_rows)
            words = np.concatenate([words_of(batch[x]) for x in ("words_one", "words_two")]) if len(n) else np.zeros((0, 1), "<u8")
            fits = agree(words, n, n + len(n), np.minimum(batch["size_one"].to_numpy(), batch["size_two"].to_numpy()))
            yield batch.select(["one", "two"]).filter(pa.array(fits))

    pairs = cut(pairs.select("one", "two", "size_one", "size_two", "words_one", "words_two").mapInArrow(agreeing, "one long, two long"))
    named = families(pairs)
    hot = cut(named.groupBy(F.col("family").alias("__family")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1"))
    placed = salted(pairs, named, "one", "node", "two").join(F.broadcast(hot) if hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else hot, F.col("family") == F.col("__family"), "left")
    one, two = (F.pmod(F.xxhash64(x), F.coalesce("blocks", F.lit(1))).cast("int") for x in ("one", "two"))
    placed = cut(placed.select("family", F.least(one, two).alias("lo"), F.greatest(one, two).alias("hi"), "one", "two"))
    asked = cut(placed.select("family", "lo", "hi", F.col("one").alias("node")).union(placed.select("family", "lo", "hi", "two")).distinct())
    ready = asked.join(shingle_sets(keys, asked.select("node")), F.col("node") == F.col("id")).select("family", "lo", "hi", "node", F.lit(None).cast("long").alias("other"), "hashes")
    ready = ready.union(placed.select("family", "lo", "hi", "one", "two", F.lit(None).cast("binary")))
    ready = ready.repartition(parts, "family", "lo", "hi").sortWithinPartitions("family", "lo", "hi", F.col("other").isNotNull())

    @tidy
    def compare(batches):
        now, sets, up = None, {}, {}
        for batch in batches:
            a, b = [], []
            *place, node, other = (batch.column(i).to_pylist() for i in range(5))
            for here, x, y, blob in zip(zip(*place), node, other, batch.column(5)):
                if here != now:
                    a.extend(up)
                    b.extend(top(up, z) for z in up)
                    now, sets, up = here, {}, {}
                if y is None:
                    sets[x] = np.frombuffer(blob.as_buffer(), np.uint64).copy()
                    continue
                one, two = top(up, x), top(up, y)
                if one != two and alike(sets[x], sets[y]):
                    up[max(one, two)] = min(one, two)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([top(up, x) for x in up], pa.int64())], names=["a", "b"])

    return cut(ready.mapInArrow(compare, "a long, b long"))


def near_copies(docs: DataFrame, small: int = SMALL, bucket: int = BUCKET, held: int = HELD, salt: int | None = None) -> DataFrame:
    """(key, named, doc_id, component_id) of every row; component_id is the smallest doc_id that similarity 0.8 or more reaches.

    Equal shingle sets are one node. Every pair of a common bucket that ``close`` lets through is
    compared, unless other links join the two already: in large buckets first neighbours in Gray order
    and the pivot, then those outside the pivot's component with all others. A null doc_id links as
    others do but names no component; a component of nulls alone has a null component_id and is told
    from others by ``group``. doc_id is taken as a key: of a doc_id with several texts, one stands for
    the others. Empty and null texts are one set, linked with each other alone.
    """
    parts = partitions(docs.sparkSession, docs) * 2
    keys = keyed(docs, free_salt(docs) if salt is None else salt)
    bits, tables = layout(docs.count())
    marks = cut(sketches(keys, max(2, math.ceil(bits * tables / 64))))
    least = F.min(F.when(F.col("named"), F.col("key")))
    nodes = cut(marks.groupBy("mark", "size").agg(least.alias("least"), F.coalesce(least, F.min("key")).alias("node"), F.first("fp").alias("fp"), F.first("words").alias("words"), F.first("exact").alias("exact")))
    proposed = cut(proposals(nodes, small, bucket, parts, bits, tables))
    links = verified(keys, nodes, proposed.where("bucket IS NULL").select("a", "b"), parts)
    joined = components(links)
    placed = proposed.where("bucket IS NOT NULL").join(joined, F.col("b") == F.col("node"), "left").select("bucket", "a", "b", F.coalesce("component", "b").alias("c"))
    mixed = placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max(F.when(F.expr("a = b"), F.col("c"))).alias("main"), F.count(F.lit(1)).alias("held"))
    mixed = cut(mixed.where("low <> high").select("bucket", "main", "held"))
    many = mixed.limit(BROADCAST_ROWS + 1).count()
    if many:
        rows = placed.join(F.broadcast(mixed) if many <= BROADCAST_ROWS else mixed, "bucket")
        rows = cut(rows.join(nodes.select("node", "size", "fp", "words"), F.col("b") == F.col("node")).select("bucket", "node", "size", "fp", "words", "c", "main", "held"))
        joined = components(links.union(searched(keys, rows, parts, bits, tables, held)))
    grouped = nodes.join(joined, "node", "left").select("mark", "size", "least", F.coalesce("component", "node").alias("group"))
    names = grouped.groupBy(F.col("group").alias("__group")).agg(F.min("least").alias("component_id"))
    named = grouped.join(names, F.col("group") == F.col("__group")).select(F.col("mark").alias("__mark"), F.col("size").alias("__size"), "group", "component_id")
    out = marks.join(named, (marks["mark"] == named["__mark"]) & (marks["size"] == named["__size"]))
    return out.select("key", "named", F.when(F.col("named"), F.col("key")).alias("doc_id"), "group", "component_id")


def keep_first(docs: DataFrame, small: int = SMALL, bucket: int = BUCKET) -> DataFrame:
    """One document of each group, with all columns: the one whose doc_id names the component.

    A group of null doc_ids alone keeps one of them; other nulls go. Repeated rows of the doc_id that
    stays all stay.
    """
    salt = free_salt(docs)
    found = cut(near_copies(docs, small, bucket, salt=salt))
    drop = found.where("named AND doc_id <> component_id").select(F.col("doc_id").alias("__id"))
    kept = docs.where("doc_id IS NOT NULL").join(drop, F.col("doc_id").cast("long") == F.col("__id"), "left_anti").select(*docs.columns)
    alone = found.where("NOT named AND component_id IS NULL").select(F.col("key").alias("__key"), "group").dropDuplicates(["group"])
    if alone.isEmpty():
        return kept
    nameless = docs.where("doc_id IS NULL").withColumn("__own", own_key(salt))
    return kept.union(nameless.join(alone, F.col("__own") == F.col("__key")).dropDuplicates(["__own"]).select(*docs.columns))
