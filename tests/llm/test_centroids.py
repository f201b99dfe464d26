"""Centroid clustering against plain Lloyd rounds in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from lantern.llm.centroids import Bounds, cluster, down, up
from lantern.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance int"


def brute(rows, k=8, rounds=10, dims=64, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))
    middle = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(middle)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(middle)):
            if mine := [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == j]:
                middle[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = assign()
    of = [sum(d for d, c in at if c == j) for j in range(len(middle))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, c, d, of[c], sum(of), sha[c]) for (i, _), (d, c) in zip(kept, at, strict=True)), key=repr)


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in cluster(df, **how).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def vectors(n, dims, seed, spread=1.0):
    r = random.Random(seed)
    hubs = [[r.gauss(0, spread) for _ in range(dims)] for _ in range(5)]
    return [(i, [x + r.gauss(0, 0.7 * spread) for x in r.choice(hubs)]) for i in range(n)]


@pytest.mark.parametrize("bounds", [0, 1, 3, 20])
def test_clusters_by_brute_force(spark, bounds):
    rows = vectors(300, 6, bounds)
    assert found(spark, rows, dims=6, bounds=bounds) == brute(rows, dims=6)


def test_odd_vectors_ties_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(x) / 1024 for x in v]) for i, v in enumerate([(0, 0), (2, 0), (0, 2), (2, 2), (1, 1), (1, 1), (-1, -1), (-3, 5)] * 4)]
    odd = [(90, None), (91, []), (92, [1.0]), (93, [1.0, None]), (94, [nan, 0.0]), (95, [0.0, -inf]), (96, [1.0, 2.0, 3.0]), (None, [0.5, 0.25]), (None, [0.5, 0.5]), (3, [0.25, 0.0]), (3, [0.25, 0.0])]
    for k in (1, 2, 3, 8):
        assert found(spark, good + odd, dims=2, k=k) == brute(good + odd, dims=2, k=k)
    assert found(spark, good[:2] + odd[:7], dims=2, k=8) == brute(good[:2], dims=2, k=8)  # fewer vectors than centroids
    same = [(i, [0.5, 0.5]) for i in range(20)]
    assert found(spark, same, dims=2) == brute(same, dims=2)  # all but one centroid stay empty
    assert found(spark, odd[:7], dims=2) == [] == found(spark, [], dims=2)
    assert found(spark, good, dims=2, rounds=0) == brute(good, dims=2, rounds=0)


def test_large_components_are_exact_and_too_large_ones_an_error(spark):
    rows = vectors(60, 4, 1, spread=150_000.0)
    assert max(abs(1024 * x) for _, v in rows for x in v) > 2**26
    assert found(spark, rows, dims=4, k=5) == brute(rows, dims=4, k=5)
    with pytest.raises(Exception, match="do not fit in a long"):
        found(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0])], dims=2)


def test_bounds_hold_and_save_work():
    r = np.random.default_rng(4)
    hubs = r.integers(-900, 900, (12, 16)).astype(float)
    x = np.floor(hubs[r.integers(0, 12, 4000)] + r.normal(0, 60, (4000, 16)))
    c, b = x[:12].copy(), Bounds(x, x[:12].copy(), 3)
    b.scan(np.arange(len(x)))
    spent = 0
    for _ in range(12):
        at = b.cluster
        new = np.array([np.floor(x[at == j].mean(0)) if (at == j).any() else c[j] for j in range(12)])
        drift, c = np.sqrt(((new - c) ** 2).sum(1)), new
        b.c = c
        spent += b.move(drift)
        d = np.sqrt(((x[:, None] - c[None]) ** 2).sum(2))
        assert (b.cluster == d.argmin(1)).all() and (b.high >= d.min(1)).all()
        rows = np.arange(len(x))[:, None]
        assert (b.low[:, :3] <= d[rows, b.near]).all()
        rest = d.copy()
        rest[rows, b.near], rest[np.arange(len(x)), b.cluster] = np.inf, np.inf
        assert (b.low[:, 3] <= rest.min(1)).all()
    assert spent < 0.35 * 12 * 12 * len(x)


def test_roots_are_rounded_outwards():
    d = np.concatenate([np.arange(2000), np.random.default_rng(1).integers(0, 2**62, 5000)])
    root = [math.isqrt(int(v)) for v in d]
    assert all(int(float(lo)) <= s and max(float(lo), 0) ** 2 <= v <= float(hi) ** 2 for lo, hi, s, v in zip(down(d), up(d), root, d.tolist(), strict=True))


def test_clusters_by_sql(spark, db):
    want = db.execute(f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({ORACLE_SQL['op12_centroids']})").fetchall()
    got = QUERIES["op12_centroids"](spark, "/root/testdata/sf0.001").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert len(want) > 400 and sorted(map(tuple, got.collect())) == sorted(want)
