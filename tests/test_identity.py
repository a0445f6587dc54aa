"""Hash trees of streams, their comparison with a manifest, and scans of lines that are never decoded."""

import datetime
import gzip
import hashlib
import json
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from barlattice.operators import identity as idn
from barlattice.operators import statistics as stt
from barlattice.plans import q_identity
from barlattice.sources import files

SMALL = "/root/testdata/sf0.001"


def streams(spark, lines):
    rows = [(s, i, x) for s, own in lines.items() for i, x in enumerate(own)]
    return spark.createDataFrame(rows, "stream string, pos long, line string").repartition(3)


def tree(lines, size):
    level = [hashlib.sha256("\n".join(x or "" for x in lines[a : a + size]).encode()).hexdigest() for a in range(0, len(lines), size)]
    while True:
        level = [hashlib.sha256("".join(level[a : a + size]).encode()).hexdigest() for a in range(0, len(level), size)]
        if len(level) == 1:
            return level[0]


LINES = {"long": [f"row {i}" for i in range(41)], "short": ["only"], "odd": ["", None, "ü|漢", "same", "same"]}


def test_roots_of_several_levels(spark):
    found = idn.roots(idn.leaves(streams(spark, LINES), "stream", ["pos"], "line", 3), "stream", 3).collect()
    assert {r.stream: (r.n_rows, r.n_bytes, r.content_sha256) for r in found} == {s: (len(x), sum(len((t or "").encode()) + 1 for t in x), tree(x, 3)) for s, x in LINES.items()}


def test_each_difference_has_its_name(spark):
    there = {**LINES, "gone": ["a"], "a": ["1", "2", "3", "4"], "b": ["1", "2", "3", "4"], "c": ["1", "2"], "d": ["1", "2", "3"]}
    here = {**LINES, "new": ["a"], "a": ["1", "2", "4", "3"], "b": ["1", "2", "3", "5"], "c": ["1", "2", "2"], "d": ["1", "3"]}
    del here["short"]
    made = [idn.leaves(streams(spark, x), "stream", ["pos"], "line", 2) for x in (here, there)]
    got = {r.stream: (r.status, r.n_rows, r.declared_rows, r.bad_leaves, r.first_bad_leaf) for r in idn.verify(*made, "stream", 2).collect()}
    assert got == {
        "long": ("SAME", 41, 41, 0, None), "odd": ("SAME", 5, 5, 0, None), "short": ("STREAM_MISSING", None, 1, 1, 0), "gone": ("STREAM_MISSING", None, 1, 1, 0), "new": ("STREAM_UNDECLARED", 1, None, 1, 0),
        "a": ("ROWS_SWAPPED", 4, 4, 1, 1), "b": ("ROWS_CHANGED", 4, 4, 1, 1), "c": ("ROWS_ADDED", 3, 2, 1, 1), "d": ("ROWS_MISSING", 2, 3, 2, 0),
    }


def test_no_streams(spark):
    none = idn.leaves(streams(spark, {"x": ["1"]}).where("false"), "stream", ["pos"], "line")
    assert idn.roots(none, "stream").collect() == [] and idn.verify(none, none, "stream").collect() == []


def test_scan_reads_no_outcomes(spark, tmp_path):
    good = '{"symbol":"600001.sh","signal_date":"2024-01-02","setup_id":"B","outcomes":{"opaque":"sealed"}}'
    other = good.replace("600001", "300001")
    rows = [good, other, other, '{"symbol":"1","signal_date":"2024-01-02"}', good[:-1] + ',"nested":{"symbol":"2"}}', good.replace('"B"', '"C"').replace("opaque", "score_85"), "not json at all", '{"nested":{"sector_rank" : 3}}']
    path = tmp_path / "events.gz"
    path.write_bytes(gzip.compress(("\n".join(rows) + "\n").encode()))
    lines = spark.read.text(str(path)).withColumn("stream", F.lit("events"))
    r = idn.scan(lines, "stream").first()
    assert (r.n_rows, r.n_bytes, r.score_rows, r.ambiguous_rows, r.duplicate_rows) == (8, sum(len(x) + 1 for x in rows), 2, 4, 1)
    seen = {tuple(x[f] for f in idn.IDENTITY) for x in idn.scanned(lines).where("problem IS NULL").collect()}
    assert seen == {("600001.sh", "2024-01-02", "B"), ("300001.sh", "2024-01-02", "B"), ("600001.sh", "2024-01-02", "C")}


@pytest.mark.parametrize("rows", [2, 1_000_000])
def test_streams_written_twice_are_the_same_files(spark, tmp_path, rows):
    lines = {"a b": ["x", "y", "z"], "c": [None, "w"]}
    out = []
    for turn in (1, 4):
        path = str(tmp_path / f"{turn}")
        files.write_streams(streams(spark, lines).repartition(turn), path, "stream", ["pos"], "line", rows)
        out.append({r.stream: (r.n_files, r.n_bytes, r.files_sha256) for r in files.file_hashes(spark, path, "stream").collect()})
        back = spark.read.schema("value string, stream string").text(path).collect()
        assert sorted((r.stream, r.value) for r in back) == sorted((s, x or "") for s, own in lines.items() for x in own)
    assert out[0] == out[1] and set(out[0]) == set(lines) and out[0]["a b"][0] == (2 if rows == 2 else 1)
    assert json.dumps(out[0])


def test_fingerprints_of_multisets(spark):
    rows = [("a", 1, None), ("a", 2, "x"), ("a", 2, "x"), ("b", 1, ""), (None, 1, "y")]
    df = spark.createDataFrame(rows, "k string, n int, t string")

    def prints(x):
        return {r.k: (r.n_rows, r.fingerprint) for r in idn.fingerprint(x, ["k"], ["n", "t"]).collect()}

    base = prints(df)
    assert prints(df.orderBy(F.rand()).repartition(7)) == base and base["a"][0] == 3
    fewer, null = df.dropDuplicates(), df.withColumn("t", F.when(F.col("k") == "b", None).otherwise(F.col("t")))
    assert {k for k in base if prints(fewer)[k] != base[k]} == {"a"} and {k for k in base if prints(null)[k] != base[k]} == {"b"}


def written(path):
    """The lines of each file below ``path``, by its stream and stretch."""
    out = {}
    for folder, _, names in os.walk(path):
        own = [n for n in names if n.endswith(".gz")]
        if own:
            assert len(own) == 1
            place = dict(x.split("=") for x in folder.split("/") if "=" in x)
            with open(f"{folder}/{own[0]}", "rb") as f:
                out[place["stream"], int(place["stretch"])] = gzip.decompress(f.read()).decode().splitlines()
    return out


@pytest.mark.parametrize("cuts", [1, 20, 10_000])
def test_stretches_are_exact(spark, tmp_path, monkeypatch, cuts):
    """With ties over the ends of stretches, nulls, and ranges that are longer or shorter than a stretch; rows are not placed as a whole."""
    monkeypatch.setattr(stt, "CUTS", cuts)
    monkeypatch.setattr(stt, "places", None)
    r = random.Random(cuts)
    rows = [(s, r.choice([None, *range(n // 3 + 1)]), r.choice([None, "", "a|", 'ü"\\漢', "b"])) for s, n in (("long", 120), ("even", 14), ("short", 3), ("one", 1)) for _ in range(n)] + [("tied", 5, "x")] * 40
    r.shuffle(rows)
    want = {}
    for s in {x[0] for x in rows}:
        own = sorted((x[1:] for x in rows if x[0] == s), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
        want |= {(s, i // 7): [x or "" for _, x in own[i : i + 7]] for i in range(0, len(own), 7)}
    for parts, line in ((1, "line"), (5, "line"), (3, F.concat("line", F.lit("")))):
        path = str(tmp_path / f"{parts}")
        files.write_streams(spark.createDataFrame(rows, "stream string, pos long, line string").repartition(parts), path, "stream", ["pos"], line, 7)
        assert written(path) == want


def test_order_of_every_type(spark):
    """Keys go through JSON where stretches begin; none may change on the way."""
    t = datetime.datetime(2024, 1, 2, 3, 4, 5)
    rows = [("s", 0.1 * i, float("nan") if i % 7 == 0 else -1e300 * i, t + datetime.timedelta(microseconds=i), t.date(), Decimal(i) / 3, bytes([i, 255]), i % 2 == 0) for i in range(50)]
    df = spark.createDataFrame(rows, "s string, a float, b double, c timestamp, d date, e decimal(38,18), f binary, g boolean")
    for first in "abcefg":
        order = [first, *[c for c in "abcdefg" if c != first]]
        x = stt.group_stretches(df.repartition(3), "s", order, 8, "at")
        places = [r.s for r in x.orderBy(*order).select(F.col("at").alias("s")).collect()]
        assert places == [i // 8 for i in range(50)]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_sinks_are_written_from_partitionings_that_differ(spark, monkeypatch):
    """Not kept, nor exchanged before they are written, and still dealt in two ways where the sink reads them."""
    seen, stretches = [], stt.group_stretches
    monkeypatch.setattr(q_identity.P, "kept", None)
    monkeypatch.setattr(stt, "group_stretches", lambda df, *a: seen.append(df) or stretches(df, *a))
    assert q_identity.equal_sinks(spark, SMALL).where("NOT (equal_bytes AND equal_content)").isEmpty()
    dealt = [{frozenset(p) for p in df.select("__line").rdd.map(lambda r: r[0]).glom().collect()} for df in seen]
    assert len(dealt) == 2 and not dealt[0] & dealt[1] and set().union(*dealt[0]) == set().union(*dealt[1])
    assert all("Exchange" not in df._jdf.queryExecution().executedPlan().toString() for df in seen)
