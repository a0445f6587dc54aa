"""Vantage-point trees and cross-polytope hashing against brute force."""

import numpy as np
import pytest

from barlattice.llm import crosspoly, vptree
from barlattice.llm.vptree import VantageTree

from . import brute

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed=1, n=300, dim=16):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dim)).astype(np.float32)
    out = []
    for i in range(n):
        v = base[i % 40] + (0.05 * r.normal(size=dim)).astype(np.float32) if i % 2 else base[i]
        out.append((i, [float(x) for x in v.astype(np.float32)], int(i % 40) % 3 if i % 2 else int(i) % 3))
    copy = out[3][1]
    out += [(n + k, copy, 0) for k in range(30)]  # equal scores: ties by id
    out += [(900, None, 1), (901, [0.0] * dim, 1), (902, [float("nan")] + [1.0] * (dim - 1), 1), (903, [None] + [1.0] * (dim - 1), 1), (904, [], 1), (905, [1.0, 2.0, 3.0], 1), (906, [2.0, 4.0, 6.0], 1), (907, copy, None), (908, [float("inf")] + [1.0] * (dim - 1), 1)]
    return out


@pytest.mark.parametrize("shard", [8, 64, 8192])
def test_nearest_is_exact(spark, shard):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in vptree.nearest(df, df.where("vec_id % 20 = 0"), shard=shard).collect()}
    assert got == brute.nearest([(i, v) for i, v, _ in rows], [(i, v) for i, v, _ in rows if i % 20 == 0])


def test_relaxed_factor_recall():
    r = np.random.default_rng(2)
    points = r.normal(size=(4000, 8))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    queries = points[:50]
    tree = VantageTree(np.arange(4000), points)
    exact = {(a, int(b)) for a, b, _ in zip(*tree.search(queries, np.arange(50), 10, 1.0))}
    brute_force = {(q, int(i)) for q in range(50) for i in np.argsort(-(points @ queries[q]), kind="stable")[1:11]}
    assert exact == brute_force
    loose = {(a, int(b)) for a, b, _ in zip(*tree.search(queries, np.arange(50), 10, 1.5))}
    assert len(loose & exact) / len(exact) >= 0.9


def test_cells_are_left_out(spark, monkeypatch):
    """Clusters far apart: exact with factor one although most shards are never visited; recall with a larger one."""
    r = np.random.default_rng(5)
    centres = 40 * np.eye(24)
    points = [centres[i % 24] + r.normal(size=24) for i in range(1200)]
    rows = [(i, [float(x) for x in p.astype(np.float32)], 0) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute.nearest([(i, v) for i, v, _ in rows], [(i, v) for i, v, _ in rows if i % 20 == 0], 10)
    visits = []
    real = vptree.searched
    monkeypatch.setattr(vptree, "searched", lambda points, asked, *rest: visits.append(asked.count()) or real(points, asked, *rest))
    got = {(x.query_id, x.rank, x.vec_id, round(x.score, 9)) for x in vptree.nearest(df, df.where("vec_id % 20 = 0"), k=10, shard=25).collect()}
    assert got == want and visits[0] < 200 and visits[1] < 200 and len(rows) / 25 * 60 == 2880
    loose = {(x.query_id, x.vec_id) for x in vptree.nearest(df, df.where("vec_id % 20 = 0"), k=10, factor=1.3, shard=25).collect()}
    assert len(loose & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want) and visits[3] <= visits[1] + 20


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1)], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id) for r in vptree.nearest(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1)]
    none = df.where("vec_id < 0")
    assert vptree.nearest(none, none).collect() == [] and crosspoly.near_duplicates(none).collect() == []


@pytest.mark.parametrize("bucket", [4096, 16])
def test_cosine_groups(spark, bucket):
    rows = vectors(3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in crosspoly.near_duplicates(df.selectExpr("*", "1 AS id", "2 AS dim", "3 AS tab"), bucket=bucket).collect()}
    assert got == brute.cosine_groups(rows)


@pytest.mark.parametrize("width", [1, 2, 3])
def test_recall_of_the_settings(spark, width):
    """Pairs at just the limit, with the production tables and margins of each width: nearly all are found, none twice."""
    r = np.random.default_rng(width)
    x = r.normal(size=(800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.normal(size=(800, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.9801 * x + np.sqrt(1 - 0.9801**2) * z
    rows = [(2 * i + j, [float(c) for c in v.astype(np.float32)], 1) for i, p in enumerate(zip(x, y)) for j, v in enumerate(p)]
    out = crosspoly.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=width).collect()
    assert all(o.n_links <= 1 and o.component_id in (o.vec_id, o.vec_id - o.vec_id % 2) for o in out)
    assert sum(o.n_links for o in out) >= 0.995 * len(rows)


@pytest.mark.parametrize("dim", [2, 3, 8, 64, 256, 768, 1024])
def test_recall_and_copies_in_other_dimensions(dim):
    """Pairs at cosine 0.98 with the production tables and margins: nearly all meet, and no vector is in many buckets."""
    r = np.random.default_rng(dim)
    x, z = r.normal(size=(2, 400, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    for width, (tables, _) in crosspoly.SETTINGS.items():
        h = crosspoly.Hashes(dim, tables, width)
        margin, met, copies = crosspoly.reach(width, h.padded), np.zeros(len(x), bool), 0
        for t in range(tables):
            a, b = ([h.codes(v, t, f) for f in range(width)] for v in (x, y))
            i = np.arange(len(x))
            met |= (sum(g[i, m] for (m, _), (_, g) in zip(a, b)) <= margin) | (sum(g[i, m] for (m, _), (_, g) in zip(b, a)) <= margin)
            copies += len(h.probes(a, margin)[0]) / len(x)
        assert met.mean() >= 0.98 and copies < 40


@pytest.mark.parametrize("dim", [2, 200])
def test_cosine_groups_in_other_dimensions(spark, dim):
    rows = [(i, v, c) for i, v, c in vectors(dim, n=240, dim=dim) if v is None or len(v) in (0, dim)]
    got = {tuple(x) for x in crosspoly.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute.cosine_groups(rows)


@pytest.mark.parametrize("width", [2, 3])
def test_several_functions_per_table(spark, width):
    rows = vectors(4, n=200)
    usable = [(i, v, c) for i, v, c in rows if brute.usable(v) and c is not None and len(v) == 16]
    got = {r.vec_id: r.n_links for r in crosspoly.near_duplicates(spark.createDataFrame(usable, SCHEMA), tables=8, margin=0.12, width=width).collect()}
    want = {i: n for i, n, _, _ in brute.cosine_groups(usable)}
    assert sum(got.values()) >= 0.98 * sum(want.values()) and all(got[i] <= want[i] for i in got)


def test_repeated_rows_and_null_ids(spark):
    """Rows of one vec_id never link with each other; a null one links with nothing and is no neighbour."""
    v, w = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0]
    df = spark.createDataFrame([(1, v, 1), (1, v, 1), (2, w, 1), (None, v, 1), (20, w, None)], SCHEMA)
    out = crosspoly.near_duplicates(df).collect()
    assert sorted((r.vec_id or 0, r.component_id, r.kept) for r in out if r.vec_id in (1, 2, 20)) == [(1, 1, True), (1, 1, True), (2, 1, False), (20, 20, True)]
    assert [(r.n_links, r.component_id) for r in out if r.vec_id is None] == [(0, None)]
    found = vptree.nearest(df.selectExpr("*", "1 AS id", "2 AS cell", "3 AS score"), df.where("vec_id = 20 OR vec_id IS NULL")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found) == [(20, 1, 2), (20, 2, 1), (20, 3, 1)]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(crosspoly.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
