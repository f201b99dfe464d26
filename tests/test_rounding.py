"""Cosines that reach a bound by rounding, and blocks that take no part in results."""

import numpy as np
from pyspark.sql import functions as F

from lantern.operators import quality


def test_pairs_that_round_up_to_the_bound(spark):
    """0.2999997 rounds to 0.3, 0.2999994 doesn't."""
    rows = [(1, 0, [1.0, 0.0, 0.0]), *((i, 0, [c, 0.0, float(np.sqrt(1 - c * c))]) for i, c in ((2, 0.2999997), (3, 0.2999994)))]
    df = spark.createDataFrame(rows, "id long, g long, v array<double>")
    for block in (1, 16_000):
        got = quality.similar_pairs(df, 0.3, "id", "v", "g", block=block).where("a = 1").collect()
        assert [(r.a, r.b, r.similarity) for r in got] == [(1, 2, 0.3)]


def test_best_match_outside_by_brute_force(spark):
    """Copies tie to the smaller id, whatever the blocks; rows without a group take no part."""
    r = np.random.default_rng(4)
    v = r.normal(size=(40, 5)).round(1)
    v[20:30] = v[:10]
    g = [i % 3 for i in range(40)]
    rows = [(i, g[i], [float(x) for x in v[i]]) for i in range(40)]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    want = {i: min(((-s[i, j], j, g[j]) for j in range(40) if g[j] != g[i])) for i in range(40)}
    df = spark.createDataFrame([*rows, (99, None, rows[0][2])], "id long, g long, v array<double>")
    for block in (3, 7, 16_000):
        got = quality.nearest_outside(df.withColumn("v", F.col("v").cast("array<double>")), "id", "v", "g", block=block).collect()
        assert {r.id: (-r.similarity, r.best_id, r.best_group) for r in got} == want
