"""Centroids against plain integer arithmetic over all distances."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varimill.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def _plain(rows, size, k, rounds):
    kept = []
    for vec_id, v, *_ in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, tuple(math.floor(64 * float(np.float32(x))) for x in v)))

    def key(row):
        return hashlib.sha256(f"1:{'' if row[0] is None else row[0]}".encode()).hexdigest(), row[1]

    means = [v for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(means))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for c, vs in groups.items():
            means[c] = tuple(sum(x) // len(vs) for x in zip(*vs))
    found = [(vec_id, *near(v)[::-1]) for vec_id, v in kept]
    total = sum(d for *_, d in found)
    of = {c: sum(d for _, b, d in found if b == c) for _, c, _ in found}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted(((i, c, d, of[c], total, sha[c]) for i, c, d in found), key=str)


def _rows(rng, n, size):
    middles = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(middles)], 0) for i in range(n)]
    return rows + [
        (None, [0.5] * size, 1),
        (n, None, 1),
        (n + 1, [0.1] * (size - 1), 1),
        (n + 2, [None, *[0.1] * (size - 1)], 1),
        (n + 3, [float("nan"), *[0.1] * (size - 1)], 1),
        (n + 4, [float("-inf"), *[0.1] * (size - 1)], 1),
        (3, rows[3][1], 0),
        (3, rows[4][1], 0),
    ]


def _columns(df):
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


@pytest.mark.parametrize(("n", "size", "k"), [(300, 64, 16), (200, 3, 16), (6, 64, 16), (100, 2, 1)])
def test_equals_plain_arithmetic(spark, n, size, k):
    rows = _rows(random.Random(n + size), n, size)
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(3)
    report = []
    made = centroids.cluster(vectors, dimensions=size, n_centroids=k, report=report)
    assert _columns(made) == _plain(rows, size, k, 3)
    assert len(report) == 3
    if (n, k) == (300, 16):
        assert all(r < 0.7 * 303 * 16 for r in report)  # the bounds spare exact distances


def test_ties_go_to_the_smaller_number():
    rows = np.array([[0, 0], [2, 0], [1, 5]], np.int64)
    means = np.array([[4, 0], [0, 0], [0, 0], [-4, 0]], np.int64)
    pivots = np.array([[9, 9]], np.int64)
    chosen, squares, _ = centroids.nearest(rows, centroids._pivot_distances(rows, pivots), means, pivots)
    assert chosen.tolist() == [1, 0, 1] and squares.tolist() == [0, 4, 26]


def test_odd_tables(spark):
    empty = centroids.cluster(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    same = [(1, [0.25] * 64, 0)] * 30
    clash = spark.createDataFrame(same, SCHEMA).withColumns({c: F.lit("x") for c in ("v", "cluster", "c_cluster", "to_pivots")})
    made = _columns(centroids.cluster(clash))
    assert len(made) == 30 and {r[1:5] for r in made} == {(0, 0, 0, 0)}
    assert set(centroids.cluster(clash).columns) == set(empty.columns)
    with pytest.raises(Exception, match="on the grid"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64, 0)], SCHEMA)).collect()
