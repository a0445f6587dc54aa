"""SimHash, suffix and word-window dedup against brute force, with the awkward cases."""

import random

import pytest

from barlattice.llm import anchors, automata, simhash, suffixes

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß漢") for _ in range(r.randint(1, 8))) for _ in range(300)]
    line = " ".join(r.choice(vocabulary) for _ in range(40))
    docs = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 200))]
        if i % 3 == 0:
            at = r.randint(0, len(words))
            words[at:at] = line.split(" ")
        docs.append((i, " ".join(words)))
    for i in range(n, n + 20):  # near copies: some words changed
        words = docs[r.randrange(n)][1].split(" ")
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = "changed"
        docs.append((i, " ".join(words)))
    docs += [(200, docs[5][1]), (201, docs[5][1]), (202, docs[5][1].upper()), (203, None), (204, ""), (205, "  \n\t "), (206, "one"), (207, "x" * 700), (208, "y" * 49 + "x" * 200), (209, "a b " * 300), (210, "\x00" * 120), (211, "\x00" * 60 + "z")]
    r.shuffle(docs)
    return docs


def frame(spark, docs, schema="doc_id long, text string"):
    return spark.createDataFrame(docs, schema)


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_simhash(spark, seed):
    docs = corpus(seed)
    assert rows(simhash.near_duplicates(frame(spark, docs))) == brute.simhash(docs)


def test_simhash_buckets_split(spark):
    marks = spark.createDataFrame([((i % 7) | (i // 7) << 40,) for i in range(400)], "fp long")
    from barlattice.llm.common import components

    whole = rows(components(simhash.links(marks, bucket=50_000)))
    assert whole == rows(components(simhash.links(marks, bucket=30))) and len(whole) == 400


def test_simhash_links_through_null_ids(spark):
    """A document without a doc_id links others and takes their name."""
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]

    def changed(*places):
        return " ".join("x" + w if i in places else w for i, w in enumerate(base))

    docs = [(7, changed()), (None, changed(3)), (1, changed(3, 200)), (None, changed(3, 200, 390)), (None, "quite another text")]
    marks = [brute.fingerprint(t) for _, t in docs]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in zip(marks[:3], marks[1:4])) and len(set(marks)) == 5
    out = {r.fingerprint: r.component_id for r in simhash.near_duplicates(frame(spark, docs)).collect()}
    assert [out[f"{m:016x}"] for m in marks] == [1, 1, 1, 1, None]


def test_gray_index_search():
    import numpy as np

    r = np.random.default_rng(4)
    values, groups = r.integers(0, 2**64, 300, dtype=np.uint64), np.sort(r.integers(0, 5, 300)) * 2
    order = np.lexsort((simhash.gray_rank(values), groups))
    values = values[order]
    asked, asked_groups = r.integers(0, 2**64, 40, dtype=np.uint64), r.integers(0, 11, 40)
    got = {(int(a), int(b)) for x, y in simhash.GrayIndex(groups, values).search(asked, asked_groups, 24, chunk=7) for a, b in zip(x, y)}
    assert got == {(i, j) for i in range(40) for j in range(300) if asked_groups[i] == groups[j] and bin(int(asked[i] ^ values[j])).count("1") <= 24}


def test_gray_index_finds_all_pairs():
    import numpy as np

    r = np.random.default_rng(3)
    base = r.integers(0, 2**64, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) for _ in range(5)]]))
    values = values[np.argsort(simhash.gray_rank(values), kind="stable")]
    buckets = np.zeros(len(values), np.int64)
    got = {(int(a), int(b)) for x, y in simhash.GrayIndex(buckets, values).pairs(4) for a, b in zip(x, y)}
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if bin(int(values[i] ^ values[j])).count("1") <= 4}
    assert got == want


def test_long_text_in_parts():
    text = ("The Quick  brown\tfox " * 4000).encode()
    assert simhash.fingerprint(text, chunk=1000) == simhash.fingerprint(text) == brute.fingerprint(text.decode())


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes(spark, seed):
    docs = corpus(seed)
    assert rows(suffixes.deduplicate(frame(spark, docs))) == brute.suffix_dedup(docs)


@pytest.mark.parametrize("hot", [2, 8])
def test_hot_grams(spark, monkeypatch, hot):
    """With a low bound nearly every passage goes by its wider context; the results stay."""
    monkeypatch.setattr(anchors, "HOT", hot)
    docs = corpus(6, 90)
    _, found = anchors.repeated_anchors(frame(spark, docs), automata.PLAN, anchors.word_tokens)
    assert len(found)
    for function, want in ((suffixes.deduplicate, brute.suffix_dedup), (automata.deduplicate, brute.window_dedup)):
        assert rows(function(frame(spark, docs))) == want(docs)


@pytest.mark.parametrize("seed", [1, 2])
def test_automata(spark, seed):
    docs = corpus(seed)
    assert rows(automata.deduplicate(frame(spark, docs))) == brute.window_dedup(docs)


@pytest.mark.parametrize("warm", [False, True])
@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_small_parts_runs_and_shards(monkeypatch, kind, warm):
    """From texts to spans in this process, with texts in many parts, many runs and many automata."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(anchors, "PART", 64)
    monkeypatch.setattr(automata, "RUN", 50)
    monkeypatch.setattr(suffixes, "RUN", 50)
    monkeypatch.setattr(automata, "SHARD", 40)
    docs = sorted(corpus(3), key=lambda d: d[0])
    plan, tokens, out, settle, want = {
        "bytes": (suffixes.PLAN, anchors.byte_tokens, suffixes.sorted_runs, suffixes.merge_parcels, brute.suffix_dedup),
        "words": (automata.PLAN, anchors.word_tokens, automata.word_passages, automata.match_parcels, brute.window_dedup),
    }[kind]
    column = pa.array([t for _, t in docs], pa.string())
    hashes, owners, spots = anchors.anchors_of(*tokens(*anchors.text_buffer(column)), plan)
    hot = np.unique(anchors.gram_key(hashes, 3)) if warm else np.zeros(0, np.uint64)
    places = [np.unique(spots[owners == i]).astype("<u4").tobytes() for i in range(len(docs))]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), column, pa.array(places, pa.binary())], names=["doc_id", "text", "__spots"])
    buckets, found = {}, []
    for what, bucket, blob in out(iter([batch.slice(0, 40), batch.slice(40)]), plan, 3, hot):
        if what == 0:
            buckets.setdefault(bucket, []).append(blob)
        else:
            d, s, n = anchors.unpack(blob)
            found += zip(np.cumsum(d).tolist(), s.tolist(), (s + n).tolist())
    for blobs in buckets.values():
        found += zip(*(x.tolist() for x in settle(blobs, plan)))
    covered = {}
    for d, s, e in found:
        covered.setdefault(d, set()).update(range(s, e))
    assert {i: len(covered.get(i, ())) for i, _ in docs} == {r[0]: r[2] for r in want(docs)}


def test_loser_tree_prefixes():
    r = random.Random(4)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 30))) for _ in range(7)]

    def lcp(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    known = [[0] + [lcp(a, b) for a, b in zip(x, x[1:])] if x else [] for x in runs]
    order, lengths = suffixes.merge(runs, known)
    merged = [runs[a][b] for a, b in order]
    assert merged == sorted(x for run in runs for x in run)
    assert lengths[1:] == [lcp(a, b) for a, b in zip(merged, merged[1:])]


def test_suffix_automaton():
    r = random.Random(5)
    passages = [[r.choice("ab") for _ in range(r.randint(1, 12))] for _ in range(30)]
    automaton = automata.SuffixAutomaton()
    for n, p in enumerate(passages):
        automaton.add(n, p)
    for p in passages:
        found = {(end, n, there) for end, n, there in automaton.first_starts(p, 3)}
        for end in range(3, len(p) + 1):
            key = p[end - 3 : end]
            first = next((n, e) for n, q in enumerate(passages) for e in range(3, len(q) + 1) if q[e - 3 : e] == key)
            assert (end, *first) in found


@pytest.mark.parametrize("function", [simhash.near_duplicates, suffixes.deduplicate, automata.deduplicate])
def test_empty_table_and_null_ids(spark, function):
    assert function(frame(spark, [])).collect() == []
    docs = [(None, "some text here " * 10), (1, "some text here " * 10), (2, None)]
    out = {r[0]: r for r in function(frame(spark, docs)).collect()}
    assert set(out) == {None, 1, 2}


@pytest.mark.parametrize("function", [simhash.near_duplicates, suffixes.deduplicate, automata.deduplicate])
def test_repeated_rows(spark, function):
    text = " ".join(f"w{i}" for i in range(60))
    out = function(frame(spark, [(1, text), (1, text), (2, text)])).collect()
    assert len(out) == 3 and len({tuple(r) for r in out if r[0] == 1}) == 1


def test_stages_keep_columns(spark):
    docs = [(i, t, "en", "s", len(t or "")) for i, t in corpus(1)]
    df = frame(spark, docs, SCHEMA).selectExpr("*", "doc_id AS __id", "text AS fp", "1 AS node", "2 AS component", "3 AS __spans")
    cut = suffixes.without_repeats(df)
    assert cut.columns == df.columns and cut.count() == len(docs)
    n = {r.doc_id: len(r.text.encode()) for r in cut.collect()}
    for i, size, removed, *_ in brute.suffix_dedup([(d[0], d[1]) for d in docs]):
        assert size - removed - 8 <= n[i] <= size - removed
