"""Token counts against the tokenizers library."""

import json
import random

import pyarrow.parquet as pq
import pytest

from barlattice.llm import bpecount


def library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(bpecount.VOCABULARY))


def counts_of(texts, tokenizer=None):
    return [len(e.ids) for e in (tokenizer or library()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def texts():
    r = random.Random(4)
    out = ["Hello  world's 123", "", None, "漢字かな " * 50, "a" * 5000, "x1" * 3000, " \n\n tail", "<|endoftext|> ordinary<|startoftext|>x<|endoftext", "😀 é ́a K Å ﬁ ǅ ẞ İΣΣ", "don'T STOP\tnow 42abc we'll",
           "a\x1cb \x1d x\x85y\xa0z w　q​k﻿m᠎n", "   \x0b\x0c ", "".join(r.choice("abcdefghijklmnop") for _ in range(20_000)), "".join(r.choice("漢字かなабв") for _ in range(4_000))]
    return out + ["".join(r.choice("ab1 '\n\tés.," if n % 2 else "字漢ก้า。、，'’1aé🙂<|>") for _ in range(300)) for n in range(200)]


def test_counts(spark):
    rows = list(enumerate(texts())) + [(None, "no id"), (1, ""), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS n_bytes")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in bpecount.count_tokens(df).collect())
    want = sorted((i if i is not None else -1, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, counts_of([t for _, t in rows])))
    assert got == want and any(w[3] for w in want)
    assert bpecount.count_tokens(df.where("false")).collect() == []


def test_documents(spark):
    """The registered query over all documents of the smallest tables."""
    from barlattice.llm import queries

    folder = "/root/testdata/sf0.001"
    table = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = dict(zip(table["doc_id"], counts_of(table["text"])))
    assert {r.doc_id: r.n_tokens for r in queries.QUERIES["op12_bpecount"](spark, folder).collect()} == want


@pytest.mark.parametrize("long", [1, 4, 1 << 30])
def test_linked_and_shrinking_arrays_agree(monkeypatch, long):
    import public_tokenizers as P

    monkeypatch.setattr(bpecount, "LONG", long)
    monkeypatch.setattr(bpecount, "PIECE", 64)
    monkeypatch.setattr(bpecount, "CACHE_CHARS", 500)
    some = [t for t in texts() if len(t or "") < 6000]
    assert bpecount.Counting(P.path(bpecount.VOCABULARY)).counts(some) == counts_of(some)


def reference(word: bytes, merges: bpecount.Merges) -> int:
    """One word, one merge at a time: the lowest rank, of equal ones the leftmost."""
    s = [*word[:-1], word[-1] + 256]
    table = {(int(k) // merges.base, int(k) % merges.base): int(r) for k, r in zip(merges.keys, merges.ranks)}
    while True:
        best = min(((table[p], i) for i, p in enumerate(zip(s, s[1:])) if p in table), default=None)
        if best is None:
            return len(s)
        s[best[1] : best[1] + 2] = [int(merges.made[best[0]])]


def test_merges_whose_results_merge_at_lower_ranks():
    """Not so in vocabularies that were trained, but a file may say it: then places are merged one by one."""
    r = random.Random(2)
    for _ in range(60):
        parts, merges = ["a", "b", "c", "c</w>", "a</w>"], []
        for _ in range(14):
            x, y = r.choice([p for p in parts if not p.endswith("</w>")]), r.choice(parts)
            if (x, y) not in merges:
                merges.append((x, y))
                parts.append(x + y)
        r.shuffle(merges)
        usable, known = [], set("abc") | {c + "</w>" for c in "abc"}
        made = {x + y for x, y in merges}
        usable = [(x, y) for x, y in merges if {x, y} <= known | made]
        ids = {}
        try:
            table = bpecount.Merges(usable, "</w>")
        except KeyError:  # a part that only a later merge makes: no vocabulary
            continue
        words = ["".join(r.choice("abc") for _ in range(r.randint(1, 24))).encode() for _ in range(40)]
        want = [reference(w, table) for w in words]
        for long in (0, 1 << 30):
            old, bpecount.LONG = bpecount.LONG, long
            try:
                assert table.count(words).tolist() == want, (usable, ids)
            finally:
                bpecount.LONG = old


def test_other_vocabularies_are_refused(tmp_path):
    import public_tokenizers as P

    with pytest.raises(ValueError):
        bpecount.Counting(P.path("byte_bpe_50k.json"))
    told = json.load(open(P.path(bpecount.VOCABULARY), encoding="utf-8"))
    told["model"]["dropout"] = 0.1
    path = tmp_path / "v.json"
    path.write_text(json.dumps(told), encoding="utf-8")
    with pytest.raises(ValueError):
        bpecount.Counting(str(path))
