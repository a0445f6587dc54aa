"""BPE round trip, mixing, language id, resampling and revisits."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from barlattice.llm import langid, mixing, resample, revisit, tokenize

from . import brute

TEXTS = ["Hello  world's 123", "", None, "漢字かな " * 50, "a" * 5000, "x1" * 3000, " \n\n  tail ", "<|endoftext|> ordinary", "\U0001f600 emoji", "don't  stop\tnow 42abc"]


def coder():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(tokenize.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("piece", [7, 100, 1 << 20])
def test_round_trip(spark, piece):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    e = coder()
    for r in tokenize.round_trip(df, piece=piece, with_ids=True).collect():
        text = TEXTS[r.doc_id] or ""
        ids = e.encode_ordinary(text)
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_decode(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    out = tokenize.decode(tokenize.round_trip(df, with_ids=True)).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in out} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokenize.round_trip(df.where("false")).collect() == []


def test_pieces_are_safe():
    r = random.Random(1)
    e = coder()
    for n in range(100):
        text = "".join(r.choice("ab1 '\n\tés.," if n % 2 else "字漢ก้า。、，'’1aé🙂") for _ in range(200))
        assert "".join(tokenize.pieces(text, 9)) == text
        assert sum((e.encode_ordinary(p) for p in tokenize.pieces(text, 9)), []) == e.encode_ordinary(text)


def test_very_long_texts_and_repeated_rows(spark):
    """Texts of several pieces at the production size, one of them without any space; null and repeated doc_ids."""
    texts = ["漢字かな交じり文、句読点だけ。" * 160_000, "plain words, 1234 numbers and don'ts\n" * 60_000, "x" * 1_200_000]
    df = spark.createDataFrame([(None, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[2][:50_000])], "doc_id long, text string").selectExpr("*", "1 AS ids")
    assert max(map(len, tokenize.pieces(texts[0]))) <= tokenize.PIECE
    e = coder()
    out = tokenize.round_trip(df).collect()
    want = {None: texts[0], 1: texts[1], 2: texts[2][:50_000]}
    assert sorted(r.doc_id or 0 for r in out) == [0, 1, 1, 2]
    for r in out:
        parts = [e.encode_ordinary(p) for p in tokenize.pieces(want[r.doc_id], 1 << 16)]
        ids = np.concatenate([np.array(p, "<u4") for p in parts])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def documents(seed=2, n=400):
    r = random.Random(seed)
    out = []
    for i in range(n):
        source = r.choice(["a"] * 6 + ["b", "c", "Z", None])
        size = r.randint(0, 400)
        out.append((i, None if i % 50 == 0 else " ".join(["w"] * size), source))
    return out


@pytest.mark.parametrize("shard", [1_000_000, 2_000])
def test_mixing(spark, shard):
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS party", "3 AS seats")
    rows = mixing.mix(df, shard=shard).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(docs)))
    sizes: dict = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(brute.words(text))
    want = brute.targets(sizes)
    taken: dict = {}
    for r in rows:
        assert r.size == len(brute.words(docs[r.doc_id][1])) and 0 <= r.taken <= 3 * r.size
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, target in want.items():
        shards = max(1, -(-sizes[source] // shard))
        assert abs(taken[source] - target) <= mixing.BLOCK * (1 + shards), source
    again = {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(3), shard=shard).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_mixing_small_sources(spark):
    """Targets of a few words are met too, and rows without a doc_id take part."""
    for sizes in ({"a": 20, "b": 10}, {"a": 100_000, "b": 3, None: 1}, {"x": 0, "y": 5}):
        docs = [(None if i == 0 else i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())]
        rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), with_rows=True).collect()
        want = brute.targets(sizes)
        assert {r.source: r.row.c1 for r in rows} == {s: t for _, t, s in docs}
        for r in rows:
            assert abs(r.taken - want[r.source]) <= max(1, 0.07 * want[r.source]), (sizes, r)


def test_seats_are_sainte_lague(spark):
    r = random.Random(3)
    votes = [r.random() ** 3 * 1000 for _ in range(15)]
    for total in (0, 1, 7, 200, 1001):
        df = spark.createDataFrame([(0, i, v, total) for i, v in enumerate(votes)], "g int, party int, votes double, total long")
        got = {x.party: x.seats for x in mixing.seats(df, ["g"], "votes", "total").collect()}
        assert [got[i] for i in range(15)] == brute.sainte_lague(votes, total)


def test_mixing_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    one = mixing.mix(spark.createDataFrame([(1, None, None), (1, None, None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.taken) for r in one] == [(0, 0)] * 2


LANGS = {"en": "the of and ing tion was that", "de": "der die und ich sch ein über", "fr": "le la des été que pour dans"}


def multilingual(n=240):
    r = random.Random(4)
    out = []
    for i in range(n):
        lang = r.choice(list(LANGS))
        out.append((i, " ".join(r.choice(LANGS[lang].split()) for _ in range(r.randint(3, 80))), lang if i % 10 else None))
    return out


def test_language_id(spark):
    docs = multilingual()
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 456 !!", "en"), (1003, "字" * 3, None), (1004, "the of and " * 20000, "en")]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS letters", "3 AS row")
    out = {r.doc_id: r for r in langid.identify(df).collect()}
    truth = {i: next(k for k, v in LANGS.items() if t.split()[0] in v.split()) for i, t, _ in docs}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in out)
    assert sum(out[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values())
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and out[1004].lang_pred == "en"
    kept = langid.known(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.rejected}


def test_language_id_learns_nothing(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.identify(df).select("lang_pred", "score", "rejected").collect()] == [("und", 0.0, True)]
    assert langid.identify(df.where("false")).collect() == []


def test_language_id_learns_rare_languages(spark):
    """Nine languages, one rare, over a joint bound: the frequent ones must not take all rows."""
    docs = [(i, f"text of l{i % 8} " * 5, f"l{i % 8}") for i in range(4000)] + [(4000 + i, "zeta xi " * 9, "rare") for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(df, per_language=64, in_all=72)
    assert model.languages == sorted({lang for _, _, lang in docs})
    assert {r.lang_pred for r in langid.predict(df.where("lang = 'rare'"), model).collect()} == {"rare"}


def test_language_id_ignores_labels(spark):
    df = spark.createDataFrame(multilingual(), "doc_id long, text string, lang string")
    model = langid.fit(df)
    a = {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    b = {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(df.selectExpr("doc_id", "text", "'xx' AS lang"), model).collect()}
    assert a == b


def test_resample(spark):
    r = random.Random(6)
    good, bad = "clean prose about rivers and towns".split(), "junk click buy now spam".split()
    docs = [(i, " ".join(r.choice(good if i % 2 else bad) for _ in range(60))) for i in range(300)] + [(900, None), (901, ""), (902, docs_copy := "clean prose about rivers"), (903, docs_copy)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS key")
    labels = spark.createDataFrame([(i,) for i in range(1, 120, 2)], "doc_id long")
    rows = {x.doc_id: x for x in resample.resample(df, labels, share=0.5).collect()}
    assert len(rows) == len(docs) and sum(x.selected for x in rows.values()) == round(0.5 * len(docs))
    assert sum(rows[i].selected for i in range(1, 300, 2)) > 145
    assert rows[900].log_weight == rows[901].log_weight == 0 and rows[902].log_weight == rows[903].log_weight
    cutoff = sorted((x.key for x in rows.values()), reverse=True)[round(0.5 * len(docs)) - 1]
    assert all(x.selected == (x.key >= cutoff) for x in rows.values())
    again = {(x.doc_id, x.selected) for x in resample.resample(df.repartition(3), labels, share=0.5).collect()}
    assert again == {(i, x.selected) for i, x in rows.items()}
    assert resample.resample(df.where("false"), labels).collect() == []


def test_top_with_ties(spark):
    df = spark.createDataFrame([(i, float(i // 10)) for i in range(100)], "doc_id long, key double")
    for k in (1, 15, 37, 100):
        got = {r.doc_id for r in resample.top(df, k).where("selected").collect()}
        assert got == {i for _, i in sorted((-(i // 10), i) for i in range(100))[:k]}


def test_top_of_many_bands_and_repeated_rows(spark):
    """Keys far apart, keys closer than any band, equal keys, null and repeated doc_ids."""
    keys = [(i, i * 2000.0) for i in range(500)] + [(i, 1e-300 * i) for i in range(500, 900)] + [(-(2**62) - i, 7.0) for i in range(50)] + [(2**62 + i, 7.0) for i in range(50)] + [(None, 7.0), (None, 7.0)]
    r = random.Random(1)
    r.shuffle(keys)
    df = spark.createDataFrame(keys, "doc_id long, key double")
    order = sorted(keys, key=lambda x: (-x[1], x[0] is None, x[0] or 0))
    for k in (1, 400, 499, 520, 560, 600, 650, 1001, 1002):
        got = sorted(((x.doc_id, x.key) for x in resample.top(df, k, bands=16).where("selected").collect()), key=str)
        assert got == sorted(order[: 601 if k == 600 else k], key=str), k  # both null rows, being equal, or none
    twice = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 5.0), (3, 9.0)], "doc_id long, key double")
    assert sorted(x.doc_id for x in resample.top(twice, 2).where("selected").collect()) == [1, 1, 3]


def test_log_weights(spark):
    """The model's ratios from counts of hashed words and pairs, counted anew in plain Python."""
    import math

    from barlattice.llm.anchors import scramble, word_tokens

    docs = [(1, "Alpha beta gamma"), (2, "beta beta"), (3, None), (4, ""), (5, "alpha delta"), (5, "alpha delta"), (None, "gamma beta alpha")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS raw", "2 AS wanted")
    buckets = 64

    def codes(text):
        w = [brute_token(x) for x in brute.words((text or "").lower())]
        pairs = [int(scramble(np.array([a], np.uint64) * np.uint64(3) + np.uint64(b))[0]) for a, b in zip(w, w[1:])]
        return [x >> 58 for x in w + pairs]

    def brute_token(word):
        data = np.frombuffer(word.encode(), np.uint8)
        return int(word_tokens(data, np.array([0, len(data)]))[0][0])

    raw, target = [1.0] * buckets, [1.0] * buckets
    for i, t in docs:
        for c in codes(t):
            raw[c] += 1
            target[c] += i in (1, 5)
    model = [math.log(t / sum(target)) - math.log(r / sum(raw)) for t, r in zip(target, raw)]
    out = resample.resample(df, spark.createDataFrame([(1,), (5,), (5,), (None,)], "doc_id long"), share=1.0, buckets=buckets).collect()
    assert len(out) == len(docs) and all(r.selected for r in out)
    for i, t in docs:
        mine = [r for r in out if r.doc_id == i]
        assert all(r.n_grams == len(codes(t)) and abs(r.log_weight - sum(model[c] for c in codes(t))) < 1e-9 for r in mine)
        assert len({r.key for r in mine}) == 1


REC = "record_id long, url string, ts long, type string, http_status int, headers map<string,string>, digest string"


def test_revisit(spark):
    rows = [
        (1, "http://www.A.com/x/#f", 10, "response", 200, {"etag": '"1"', "content-length": "9", "cache-control": "old"}, "d1"),
        (2, "https://a.com/x", 20, "revisit", 304, {"etag": 'W/"1"', "content-length": "0", "cache-control": "new"}, None),
        (3, "https://a.com/x", 5, "revisit", 304, {}, None),
        (4, "a.com/x?utm_source=q", 30, "response", 200, {"last-modified": "t"}, "d2"),
        (5, "a.com/x", 40, "revisit", 304, {"etag": '"1"'}, None),
        (6, "a.com/x", 41, "revisit", 304, {"last-modified": "u"}, None),
        (7, "a.com/x", 42, "revisit", 304, None, "d2"),
        (8, None, 42, "revisit", 304, None, None),
        (9, "a.com/x", None, "revisit", 304, None, None),
        (10, "a.com/x", 50, "response", 404, {"etag": "e"}, "d3"),
        (11, "a.com/x", 60, "revisit", 304, {"last-modified": "t"}, None),
        (12, "a.com/x", 30, "revisit", 304, {"last-modified": "t"}, None),
    ]
    df = spark.createDataFrame(rows, REC).withColumnRenamed("zzz", "zzz").selectExpr("*", "1 AS found", "2 AS status")
    out = {r.record_id: r for r in revisit.resolve(df).collect()}
    assert {i: r.status for i, r in out.items()} == {2: "resolved", 3: "no_earlier_response", 5: "no_validator", 6: "validator_mismatch", 7: "resolved", 8: "no_earlier_response", 9: "no_earlier_response", 11: "resolved", 12: "resolved"}
    assert out[2].refers_to == 1 and out[2].headers == {"etag": '"1"', "content-length": "9", "cache-control": "new"} and out[2].digest == "d1"
    assert out[7].refers_to == 4 and out[11].refers_to == 4 and out[12].refers_to == 4
    assert revisit.resolve(df.where("false")).collect() == []


def test_revisit_time_slices(spark):
    r = random.Random(8)
    rows = [(i, "hot.com/p", r.randint(0, 5000), r.choice(["response", "revisit"]), 200, {}, str(i)) for i in range(400)]
    rows += [(1000 + i, "hot.com/p", 9_000 + i % 3, r.choice(["response", "revisit"]), 200, {}, str(i)) for i in range(300)]  # a burst: one slice holds it
    rows += [(2000, "hot.com/p", 10**12, "revisit", 200, {}, "x"), (2001, "hot.com/p", -(10**12), "response", 200, {}, "y"), rows[3], rows[3]]  # far times, repeated rows
    out = {x.record_id: x.refers_to for x in revisit.resolve(spark.createDataFrame(rows, REC)).collect()}
    full = sorted((t, i) for i, _, t, kind, *_ in rows if kind == "response")
    for i, _, t, kind, *_ in rows:
        if kind == "revisit":
            before = [x for x in full if x < (t, i)]
            assert out[i] == (before[-1][1] if before else None)


def test_canonical_url(spark):
    cases = {"HTTP://WWW.Ex.com:80/a/index.html": "ex.com/a", "https://m.ex.com/?utm_a=1&b=2&ref=x#z": "ex.com/?b=2", "ex.com": "ex.com", None: None, "": ""}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    from pyspark.sql import functions as F

    assert {r.u: r.c for r in df.select("u", revisit.canonical_url(F.col("u")).alias("c")).collect()} == cases


def test_language_vectors_and_rejection(spark):
    """Counts and cosines anew in plain Python; foreign texts, even short ones, are rejected, those of the corpus are not."""
    docs = multilingual()
    df = spark.createDataFrame(docs + [(i, t, lang) for i, t, lang in docs[:40]], "doc_id long, text string, lang string")
    model = langid.fit(df, dims=256)

    def counts(text):
        b = [x if x >= 0x80 or 97 <= x <= 122 else 32 for x in text.lower().encode()]
        out = np.zeros(256)
        for n in (1, 2, 3):
            for i in range(len(b) - n + 1):
                code = 0
                for x in b[i : i + n]:
                    code = (code * 257 + x) % 2**32
                out[((code + n * 0x51ED27) * 0x9E3779B1 % 2**32) >> 24] += 1
        return out

    texts = ["The and of, was!", "über und ich sch", "été", "t"]
    for text in texts:
        raw = np.frombuffer(text.lower().encode(), np.uint8)
        assert (langid.grams(raw, 256) == counts(text)).all() and (langid.grams(raw, 256, chunk=4) == counts(text)).all()
    odd = ["Η γρήγορη καφέ αλεπού πηδά πάνω", "Η αλεπού", "лиса", "字漢文本在這裡"]
    rows = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts + odd)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        v = np.log1p(counts(text)) * model.idf
        cosines = model.centroids @ (v / np.linalg.norm(v))
        assert abs(rows[i].score - cosines.max()) < 1e-4 and rows[i].lang_pred == model.languages[model.of[cosines.argmax()]]
    assert [rows[i].rejected for i in range(len(texts))] == [False] * 4
    assert all(rows[i].rejected for i in range(len(texts), len(rows)))
    assert not any(r.rejected for r in langid.predict(df, model).collect())
