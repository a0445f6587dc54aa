"""Whole-number clustering against plain rounds that compute every distance."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from barlattice.llm import hamerly

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, dim, k, rounds):
    points = [(i, [max(-hamerly.FAR, min(hamerly.FAR, math.floor(1024 * x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centroids = [p for _, p in sorted(points, key=lambda r: digest(r[0]))[:k]]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(p)[1] for _, p in points]
        centroids = [[sum(x) // len(mine) for x in zip(*mine)] if (mine := [p for (_, p), o in zip(points, own) if o == j]) else c for j, c in enumerate(centroids)]
    last = [(i, *nearest(p)) for i, p in points]
    top = hamerly.LONGEST
    inertia = [sum(min(d, top) for _, d, o in last if o == j) for j in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, min(d, top), min(inertia[j], top), min(sum(inertia), top), names[j]) for i, d, j in last)


def clustered(seed, n, dim, spread=0.3):
    r = np.random.default_rng(seed)
    centres = 3 * r.normal(size=(5, dim))
    return [(i, [float(x) for x in centres[i % 5] + spread * r.normal(size=dim)]) for i in range(n)]


def run(spark, rows, dim, **settings):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).selectExpr("*", "1 AS cluster", "2 AS distance")
    out = hamerly.cluster(df, dim, **settings).collect()
    return Counter(tuple(r)[:6] for r in out), [r.scans for r in out]


@pytest.mark.parametrize("dim,k,rounds", [(64, 8, 10), (3, 5, 18), (2, 1, 3)])
def test_against_plain_rounds(spark, dim, k, rounds):
    rows = clustered(dim, 250, dim)
    rows += [(1000 + i, rows[7][1]) for i in range(20)] + [(7, rows[7][1]), (None, rows[3][1])]  # equal vectors, a repeated and a null id
    rows += [(2000, None), (2001, [1.0] * (dim - 1)), (2002, [math.nan] * dim), (2003, [math.inf] + [0.0] * (dim - 1)), (2004, [None] + [0.0] * (dim - 1)), (2005, []), (2006, [0.0] * dim)]
    got, scans = run(spark, rows, dim, k=k, rounds=rounds)
    assert got == plain(rows, dim, k, rounds) and sum(scans) < len(scans) * (rounds + 1)


def test_ties_and_lattices(spark):
    """Points on a small lattice: many are as far from two centroids."""
    rows = [(i, [i % 4 / 1024, i // 4 % 4 / 1024, -(i // 16) / 1024]) for i in range(64)]
    got, _ = run(spark, rows, 3, k=6, rounds=8)
    assert got == plain(rows, 3, 6, 8)


def test_wide_components(spark):
    """Components beyond 27 bits are exact too; what no long can hold is the largest long."""
    rows = clustered(9, 60, 2) + [(100, [2.0e5, -3.0e5]), (101, [2.1e5, -3.0e5]), (102, [1e9, 1.0]), (103, [1e300, 0.0]), (104, [-1e300, 0.0])]
    got, _ = run(spark, rows, 2, k=6, rounds=6)
    assert got == plain(rows, 2, 6, 6)


def test_bounds_spare_scans(spark):
    _, scans = run(spark, clustered(1, 400, 16, 0.05), 16)
    assert np.mean(scans) < 5.5  # of 11 assignments


def test_few_vectors_and_none(spark):
    rows = [(5, [0.5, 0.25]), (6, [0.5, -0.25])]
    assert run(spark, rows, 2)[0] == plain(rows, 2, 8, 10)
    assert run(spark, [(1, None)], 2)[0] == Counter()
    assert hamerly.cluster(spark.createDataFrame([], SCHEMA)).collect() == []
