"""The whole pipeline, stage by stage, against plain versions on a small corpus with the awkward cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from barlattice.llm import langid

from . import brute
from .test_nearcopies import kept
from .test_text import LANGS, coder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, taken string"


def corpus():
    r = random.Random(21)
    vocabulary = {lang: list({a + b for a in w.split() for b in w.split()}) for lang, w in LANGS.items()}
    line = " ".join(vocabulary["en"][i] for i in range(30))
    docs = []
    for i in range(160):
        lang = r.choice(list(LANGS))
        words = [r.choice(vocabulary[lang]) for _ in range(r.randint(1, 150))]
        if i % 5 == 0 and lang == "en":
            words[len(words) // 2 : len(words) // 2] = line.split()
        docs.append((i, " ".join(words), lang, r.choice("aaab")))
    docs += [(200 + i, t, lang, s) for i, (_, t, lang, s) in enumerate(docs[:12])]  # copies
    docs += [(300 + i, t + " changed", lang, s) for i, (_, t, lang, s) in enumerate(d for d in docs[:60] if len(d[1].split()) > 60)]  # near copies
    docs += [(400, None, "en", "a"), (401, "", None, None), (402, "12 34 !!", "en", "a"), (403, "Η γρήγορη καφέ αλεπού πηδά πάνω από το σκυλί", None, "a"), (404, "the of", "en", "tiny"), (None, " ".join(vocabulary["de"][:40]), "de", None), (None, None, None, None)]
    docs += [docs[7], docs[7]]  # repeated rows
    r.shuffle(docs)
    return docs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, lang, s, len(t or ""), 1, "x") for i, t, lang, s in corpus()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]

    # Language ID: what is judged by the text alone, and those without a letter or foreign ones go.
    one = spark.createDataFrame(rows_of(stages["language id"](spark, docs, folder)), ", ".join(SCHEMA.split(", ")[:5]))
    rejected = {r.text for r in langid.predict(docs.select("doc_id", "text"), langid.fit(docs)).join(docs.select("doc_id", "text"), "doc_id").where("rejected").select("text").collect()}
    assert one.columns == columns
    assert Counter(rows_of(one)) == Counter(r for r in rows_of(docs) if r[1] not in rejected and any(c.isalpha() for c in r[1] or ""))
    assert {403} & {r[0] for r in rows_of(one)} == set() and 404 in {r[0] for r in rows_of(one)}

    # Near-dedup: the smallest doc_id of each group, with all its rows; the null one is alone and stays.
    two = spark.createDataFrame(rows_of(stages["simhash near-dedup"](spark, one, folder)), one.schema)
    stay = kept(sorted({(r[0], r[1]) for r in rows_of(one) if r[0] is not None}))
    assert Counter(rows_of(two)) == Counter(r for r in rows_of(one) if r[0] is None or r[0] in stay)

    # Suffix-array dedup: bytes of repeated strings go; parts of characters cut in two go with them.
    three = spark.createDataFrame(rows_of(stages["suffix-array dedup"](spark, two, folder)), one.schema)
    want = {i: n - removed for i, n, removed, *_ in brute.suffix_dedup(sorted({(r[0], r[1]) for r in rows_of(two) if r[0] is not None}))}
    assert Counter((r[0], r[2], r[3]) for r in rows_of(three)) == Counter((r[0], r[2], r[3]) for r in rows_of(two))
    for i, text, _, _, n in rows_of(three):
        assert n == len(text) and (i is None or want[i] - 8 <= len(text.encode()) <= want[i])

    # Mixing: each row as often as its words are taken, halves up.
    mixed = Counter(rows_of(stages["mix sources"](spark, three, folder)))
    plain = Counter()
    given = rows_of(three)
    for row, (_, size, taken) in zip(given, brute.mix([(r[0], r[1], r[3]) for r in given])):
        if size and int(taken / size + 0.5):
            plain[row] += int(taken / size + 0.5)
    assert mixed == plain and None in {r[0] for r in mixed}

    # BPE: ids and bytes of every text.
    four = spark.createDataFrame(list(mixed.elements()), one.schema)
    e = coder()

    def tokens(i, text):
        ids = e.encode_ordinary(text)
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    last = Counter(tuple(r) for r in stages["bpe"](spark, four, folder).collect())
    assert last == Counter(tokens(r[0], r[1]) for r in mixed.elements())
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == last


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
