"""Centroid clustering against measuring every distance in every round."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import kmeans

SCHEMA = "vec_id long, embedding array<double>, cluster int, q int, own int"


def brute(rows, clusters, rounds):
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) and abs(x) * 1024 < 2**48 for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), k) for k, x in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for k in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == k]
            if mine:
                c[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    each = [sum(d for _, d, o in last if o == k) for k in range(len(c))]
    fit = lambda x: x if x < 2**63 else None
    return [(i, k, fit(d), fit(each[k]), fit(sum(each)), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, d, k in last]


def some(seed, n, groups=5, spread=0.2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, 64))
    return [(i, (centre[i % groups] + rng.normal(size=64) * spread).tolist()) for i in range(n)]


def odd(n):
    one = [0.5] * 64
    return [(n, None), (n + 1, []), (n + 2, [1.0] * 63), (n + 3, [None, *one[1:]]), (n + 4, [float("nan"), *one[1:]]), (n + 5, [float("inf"), *one[1:]]), (None, one), (None, one), (3, one), (n + 6, [0.0] * 64), (n + 6, [0.0] * 64)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, 8, 9) for i, v in rows], SCHEMA).repartition(3)


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize(("seed", "kept", "spread"), [(1, None, 0.2), (2, 1, 1.0), (3, 7, 2.0), (4, 3, 0.0)])
def test_against_all_distances(spark, seed, kept, spread):
    """Well and badly separated vectors, few and all bounds, and vectors that all tie."""
    rows = some(seed, 120, spread=spread) + odd(120)
    seen = []
    got = kmeans.cluster(frame(spark, rows), kept=kept, seen=seen).collect()
    same(got, brute(rows, 8, 10))
    assert seen[0][1] == len(got)


def test_bounds_spare_distances(spark):
    """Separated groups: after the first rounds hardly a vector measures all centroids."""
    seen = []
    rows = some(9, 400, groups=8, spread=0.05)
    got = kmeans.cluster(frame(spark, rows), seen=seen).collect()
    same(got, brute(rows, 8, 10))
    assert len(seen) < 11 or seen[-1][1] < 40


def test_whole_numbers_of_any_size(spark):
    """Longs and beyond: distances that don't fit are null; a vector beyond the sums takes no part."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=64) * 10.0 ** (i % 11)).tolist()) for i in range(40)] + [(90, [1e200] * 64), (91, [-1e12] * 64)]
    want = brute(rows, 8, 10)
    same(kmeans.cluster(frame(spark, rows)).collect(), want)
    assert any(w[2] is None for w in want) and 90 not in {w[0] for w in want}


def test_few_and_none(spark):
    rows = some(5, 3) + [(0, some(5, 3)[0][1])]
    same(kmeans.cluster(frame(spark, rows)).collect(), brute(rows, 8, 10))
    same(kmeans.cluster(frame(spark, rows[:1])).collect(), brute(rows[:1], 8, 10))
    empty = kmeans.cluster(frame(spark, odd(0)[:6]))
    assert empty.collect() == [] and empty.columns == kmeans.cluster(frame(spark, rows)).columns


def test_floats_as_doubles(spark):
    rows = [(i, np.float32(v).astype(float).tolist()) for i, v in some(6, 50)]
    df = frame(spark, rows).withColumn("embedding", F.col("embedding").cast("array<float>"))
    same(kmeans.cluster(df).collect(), brute(rows, 8, 10))
