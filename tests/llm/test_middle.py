"""Fill-in-middle against a plain version; sentinels, nulls, long texts and the inverse."""

import hashlib
import random
import re

from barlattice.llm import middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = ["one two  three\n", "", None, " \t ", "x", "漢字 かな　交じり 文 🙂 é", "has <P> inside", "<S>", "<M", "a<P b<S> c", "ends with <", "\x1c sep\x85arated\xa0words", "A" * 10] + [" ".join(f"w{j}" for j in range(n)) + " " * (n % 3) for n in range(1, 60)]


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_a_plain_version(spark):
    rows = [(i * 7, TEXTS[i % len(TEXTS)]) for i in range(400)] + [(None, "null id text here"), (3, "twice told"), (3, "twice told")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS form", "1 AS output", "2 AS n", "3 AS __units", "4 AS kept")
    made = middle.restore(middle.transform(df))
    assert "kept" in made.columns and "__units" not in made.columns
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "", r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in made.collect())
    want = sorted(((i if i is not None else -1), t or "", *plain(i, t), t or "") for i, t in rows)
    assert got == want
    assert {w[3] for w in want} == {"plain", "spm", "psm"}
    digests = {(r.doc_id, r.n, r.form, r.output_sha256, r.restored_sha256) for r in middle.round_trip(df).collect()}
    assert digests == {(i, plain(i, t)[0], plain(i, t)[1], hashlib.sha256(plain(i, t)[4].encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}


def test_very_long_texts_and_empty_table(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice(["a", "語", "word"]) for _ in range(300_000)), "y" * 2_000_000, " " * 1_000_000 + "z" + "\n" * 1_000_000]
    rows = [(i, t) for i in range(8) for t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.restored_sha256, x.output_sha256, x.n) for x in middle.round_trip(df).collect()}
    assert got == {(i, hashlib.sha256(t.encode()).hexdigest(), hashlib.sha256(plain(i, t)[4].encode()).hexdigest(), plain(i, t)[0]) for i, t in rows}
    assert middle.round_trip(df.where("false")).collect() == []


def test_outputs_that_are_not_ones(spark):
    """Sentinels missing, doubled or in another order than the form's, an unknown form and nulls restore nothing."""
    rows = [("psm", "<P>a<S>c<M>b", "abc"), ("spm", "<S>c<P>a<M>b", "abc"), ("psm", "<S>c<P>a<M>b", None), ("psm", "<P>a<S>c", None), ("psm", "x<P>a<S>c<M>b", None), ("psm", "<P>a<S>c<M>b<M>", None),
            ("plain", "<P> as it is", "<P> as it is"), ("other", "a", None), (None, "a", None), ("psm", None, None), ("spm", "<S><P><M>", "")]
    df = spark.createDataFrame(rows, "form string, output string, want string")
    assert all(r.restored == r.want for r in middle.restore(df).collect())


def test_no_python_in_the_plan(spark):
    df = middle.round_trip(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
