"""The near-dedup stage of the pipeline against all pairs: five-word shingles, similarity 0.8 or more."""

import random
from collections import Counter

import numpy as np
import pytest

from barlattice.llm import nearcopies

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near_copies(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    docs = []
    for i in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(40, 300))]
        for _ in range(6):
            words = list(base)
            for _ in range(r.randint(0, len(base) // 20)):
                words[r.randrange(len(words))] = "changed"
            docs.append(" ".join(words))
    docs += [None, "", "  ", "one", "ONE", "a b c d e", "a b c d e f g h", "a b c d e f g h i"]
    r.shuffle(docs)
    return list(enumerate(docs))


def kept(docs):
    sets = {}
    for i, t in docs:
        w = [x.lower() for x in brute.words(t)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    groups = brute.Sets(sets)
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                groups.join(a, b)
    return {i for i in sets if groups.find(i) == i}


@pytest.mark.parametrize("small, bucket, held", [(2, 50_000, 1024), (2, 3, 2), (16, 50_000, 1024)])
def test_components(spark, small, bucket, held):
    """Also where buckets are large, or are dealt out over tasks."""
    docs = near_copies(small)
    out = nearcopies.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), small, bucket, held).collect()
    assert {r.doc_id for r in out if r.doc_id == r.component_id} == kept(docs) and len(out) == len(docs)


def test_family_of_copies_at_the_limit(spark):
    """Copies of one text with changes of their own: some pairs are near enough, most just not; links must be neither lost nor made."""
    r = random.Random(12)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    docs = []
    for i in range(120):
        words = list(base)
        for k in range(r.choice([1, 2, 2, 3])):
            words[r.randrange(len(words))] = f"own{i}x{k}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = nearcopies.near_copies(df, small=4, held=16).collect()
    assert {x.doc_id for x in out if x.doc_id == x.component_id} == kept(docs) and 1 < len(kept(docs)) < 119


def test_pipeline_stage(spark):
    import corpus_pipeline

    docs = near_copies(3)
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == kept(docs)


def test_empty_and_null_ids(spark):
    assert nearcopies.near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    text = "some text here " * 10
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, None), (None, "else"), (None, "else"), (3, "")], "doc_id long, text string")
    df = df.selectExpr("*", "1 AS key", "2 AS named", "3 AS __own")
    kept = nearcopies.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "else"), (1, text), (1, text), (2, "")]


def test_doc_ids_that_are_hashes_of_texts(spark):
    """A row without a doc_id is never taken for the document whose doc_id its text hashes to, with any salt tried."""
    long = "one text of some words " * 10
    schema = "doc_id long, text string"
    nameless = spark.createDataFrame([(None, None), (None, "alone here")], schema)
    taken = [r[0] for salt in (0, 1) for r in nameless.select(nearcopies.own_key(salt)).collect()]
    docs = nameless.union(spark.createDataFrame([(42, long), (5, "else where"), *[(i, f"stranger {n} with words of its own") for n, i in enumerate(taken)]], schema))
    assert nearcopies.free_salt(docs) == 2
    kept = nearcopies.keep_first(docs).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((r.doc_id, r.text) for r in docs.collect())


def test_null_id_joins_two_groups(spark):
    words = [f"w{i}" for i in range(100)]

    def changed(k):
        return " ".join(words[:-k] + ["x"] * k if k else words)

    docs = [(5, changed(0)), (None, changed(9)), (2, changed(18))]  # 0 and 9, 9 and 18 are near; 0 and 18 are not
    out = {r.doc_id: r.component_id for r in nearcopies.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {5: 2, None: 2, 2: 2}
    assert [r.doc_id for r in nearcopies.keep_first(spark.createDataFrame(docs, "doc_id long, text string")).collect()] == [2]


def test_long_text_in_parts():
    text = " ".join(f"w{i % 700}" for i in range(3000)).encode()
    assert nearcopies.shingles(text, chunk=100).tolist() == nearcopies.shingles(text).tolist()


def plain_simhash(hashes, count):
    """Bit by bit: those set in over half of the hashes, mixed for each word."""
    out = []
    for odd, other in nearcopies.mixers(count).T.tolist():
        mixed = [((h ^ other) * odd) % 2**64 for h in hashes.tolist()]
        mixed = [x ^ (x >> 32) for x in mixed]
        out.append(sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in mixed) > len(mixed)))
    return out


def test_buckets_are_bits_of_the_simhash():
    """Not of anything else: two documents share the bucket of a table if their SimHashes agree in its bits."""
    r = np.random.default_rng(5)
    sets = [r.integers(0, 2**64, n, dtype=np.uint64) for n in (4, 60, 700)]
    words = np.stack([nearcopies.long_simhash(x, 3, chunk=50) for x in sets])
    assert words.tolist() == [plain_simhash(x, 3) for x in sets]
    for row, got in zip(words.tolist(), nearcopies.buckets(words, 11, 17).tolist()):
        whole = sum(w << 64 * i for i, w in enumerate(row))
        assert got == [(t << 11) + (whole >> 11 * t) % 2**11 for t in range(17)]


@pytest.mark.parametrize("rows", [100, 200_000])
def test_pairs_at_the_similarity_share_a_bucket(rows):
    bits, tables = nearcopies.layout(rows)
    r = np.random.default_rng(6)
    found = 0
    for n in [9, 45, 90, 270] * 50:
        both, own = r.integers(0, 2**64, 8 * n // 9, dtype=np.uint64), r.integers(0, 2**64, 2 * (n // 9), dtype=np.uint64)
        pair = [np.concatenate([both, x]) for x in np.split(own, 2)]
        assert nearcopies.alike(*map(np.unique, pair)) and not nearcopies.alike(*map(np.unique, (np.append(pair[0], own[-1] + np.uint64(1)), pair[1])))
        words = np.stack([nearcopies.long_simhash(x, -(-bits * tables // 64)) for x in pair])
        keys = nearcopies.buckets(words, bits, tables)
        found += bool((keys[0] == keys[1]).any() and nearcopies.agree(words, np.array([0]), np.array([1]))[0])
    assert found >= 199


def test_sets_of_four_and_five_share_an_exact_bucket():
    five = np.array([5, 3, 1, 2, 4], np.uint64)
    for gone in range(5):
        assert set(nearcopies.exact_buckets(np.delete(five, gone))) & set(nearcopies.exact_buckets(five))
    assert nearcopies.exact_buckets(five[:3]) == [] and max(nearcopies.exact_buckets(five)) < 0


def test_whole_simhash_spares_sets_of_unlike_pairs():
    """Pairs at similarity 0.5 do not have their sets read, though two words alone would let them through; sets of 4 and 5 have."""
    r = np.random.default_rng(7)
    bits, tables = nearcopies.layout(51_282)
    count = -(-bits * tables // 64)
    let = few = 0
    for _ in range(50):
        both, own = r.integers(0, 2**64, 200, dtype=np.uint64), r.integers(0, 2**64, 200, dtype=np.uint64)
        words = np.stack([nearcopies.long_simhash(np.concatenate([both, x]), count) for x in np.split(own, 2)])
        let += nearcopies.agree(words, np.array([0]), np.array([1]))[0]
        words = np.stack([nearcopies.long_simhash(both[:n], count) for n in (4, 5)])
        few += nearcopies.agree(words, np.array([0]), np.array([1]), np.array([4]))[0]
    assert let <= 2 and few == 50
