import hashlib
import math

import numpy as np
import oracle_check
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.llm import centroids, oracle

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
])
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def _brute(rows, k=16, rounds=3, dim=64):
    """Python integers and a full search."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    points = [p for _, p in order[:k]]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), n) for n, c in enumerate(points))

    for _ in range(rounds):
        members = {}
        for _, p in kept:
            members.setdefault(nearest(p)[1], []).append(p)
        points = [
            [sum(x) // len(members[n]) for x in zip(*members[n])] if n in members else c
            for n, c in enumerate(points)
        ]
    found = [(i, *nearest(p)) for i, p in kept]
    sums = {}
    for _, d, n in found:
        sums[n] = sums.get(n, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in points]
    return _sorted((i, n, d, sums[n], sum(sums.values()), digest[n]) for i, d, n in found)


def _sorted(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def _found(table, **options):
    return _sorted(tuple(r) for r in centroids.cluster(table, **options).select(*COLUMNS).collect())


def _rows(n, seed=0, dim=64, spread=0.4):
    random = np.random.default_rng(seed)
    middles = random.normal(size=(9, dim))
    return [(i, (middles[i % 9] + spread * random.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def test_same_as_full_search(spark):
    rows = _rows(300)
    assert _found(spark.createDataFrame(rows, SCHEMA)) == _brute(rows)
    assert _found(spark.createDataFrame(rows, SCHEMA).repartition(5), k=7, rounds=5) == _brute(rows, 7, 5)


def test_search_rejects_and_settles_ties_by_number():
    random = np.random.default_rng(4)
    points = random.integers(-3, 4, (16, 8))
    points[5] = points[11]
    points[2] = points[3][::-1]  # the same mean and deviation
    vectors = np.vstack([random.integers(-40, 41, (3000, 8)), points, np.zeros((3, 8), int)])
    far = ((vectors[:, None, :] - points[None]) ** 2).sum(2)
    number, distance, computed = centroids.Search(points).nearest(vectors)
    assert (distance == far.min(1)).all() and (number == far.argmin(1)).all()
    apart = points + 50 * np.arange(16)[:, None]
    near = np.repeat(apart, 50, 0) + random.integers(-2, 3, (800, 8))
    number, distance, computed = centroids.Search(apart).nearest(near)
    far = ((near[:, None, :] - apart[None]) ** 2).sum(2)
    assert (distance == far.min(1)).all() and (number == far.argmin(1)).all()
    assert computed < 2 * len(near)  # of 16 each


def test_largest_components_are_exact():
    top = centroids.LARGEST - 1
    points = np.array([[top] * 64, [-top] * 64, [top] * 63 + [top - 1]], np.int64)
    number, distance, _ = centroids.Search(points).nearest(points)
    assert number.tolist() == [0, 1, 2] and distance.tolist() == [0, 0, 0]


def test_nulls_lengths_repeats_and_ties(spark):
    rows = _rows(40, seed=2)
    rows += [rows[3], rows[3], (5, rows[7][1]), (None, rows[8][1]), (900, None), (901, []), (902, [1.0] * 63)]
    rows += [(903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [float("nan")] + [0.0] * 63)]
    rows += [(906, [float("inf")] + [0.0] * 63), (907, [0.0] * 64), (908, [0.0] * 64)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert _found(table) == _brute(rows)
    named = table.withColumns({c: F.lit("x") for c in ("point", "cluster", "distance", "e", "_key", "inertia")})
    assert _found(named) == _brute(rows)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = _rows(5)
    assert _found(spark.createDataFrame(rows, SCHEMA)) == _brute(rows)
    empty = centroids.cluster(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == COLUMNS
    same = [(i, [0.5] * 64) for i in range(30)]  # fifteen clusters stay empty
    assert _found(spark.createDataFrame(same, SCHEMA)) == _brute(same)


def test_component_that_does_not_fit(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], SCHEMA)).collect()


def test_query_equals_its_sql(spark):
    con = oracle_check.duck("/root/testdata/sf0.001")
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert oracle_check.compare(centroids.cluster(table), con, oracle.oracle_sql()["op12_centroids"]) is None
