import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.llm import nearest

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
])


def _table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


def _brute(rows, k=20, every=20):
    found = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        found.append((i, [float(np.float32(x)) for x in v]))
    result = []
    for own, (q, a) in enumerate(found):
        if q % every:
            continue
        scored = []
        for other, (c, b) in enumerate(found):
            if own != other and len(a) == len(b):
                total = 0.0
                for x, y in zip(a, b):
                    total += x * y
                scored.append((-total, c))
        result += [(q, rank, c, -s) for rank, (s, c) in enumerate(heapq.nsmallest(k, scored), 1)]
    return sorted(result)


def _rows(n, dim=16, seed=0):
    random = np.random.default_rng(seed)
    return [(i, random.normal(size=dim).astype(np.float32).tolist()) for i in range(n)]


def _found(table, **sizes):
    return sorted(tuple(r) for r in nearest.search(table, **sizes).collect())


@pytest.mark.parametrize("sizes", [{}, {"block": 50, "query_block": 7}])
def test_same_as_brute_force(spark, sizes):
    rows = _rows(400)
    assert _found(_table(spark, rows), **sizes) == _brute(rows)


def test_tiles_meet_in_any_partition(spark):
    rows = _rows(300, seed=9)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        assert _found(_table(spark, rows), block=40, query_block=4) == _brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_many_lists_are_merged_in_levels(spark, monkeypatch):
    monkeypatch.setattr(nearest, "FAN", 3)
    rows = _rows(300, seed=4)
    assert _found(_table(spark, rows), block=20, query_block=5) == _brute(rows)


def test_copies_and_ties_go_by_id(spark):
    rows = _rows(60)
    rows += [(100 + k, rows[20][1]) for k in range(150)] + [(400 + k, [1.0] + [0.0] * 15) for k in range(40)]
    assert _found(_table(spark, rows), block=64, query_block=3) == _brute(rows)


def test_odd_vectors_take_no_part(spark):
    rows = _rows(45) + [
        (60, None), (80, [0.0] * 16), (100, [None] + [1.0] * 15), (120, [float("nan")] * 16),
        (140, [float("inf")] + [0.0] * 15), (160, []), (None, [1.0] * 16), (180, [1e30] * 16), (200, [1e-30] * 16),
        (220, [1.0, 2.0]), (221, [0.5, 1.0]), (240, [1.0, 1.0, 1.0]), (20, [9.0] * 16), (20, [9.0] * 16),
    ]
    table = _table(spark, rows).withColumn("score", F.lit("clash")).withColumn("dim", F.lit(1))
    assert _found(table) == _brute(rows)


def test_empty_table(spark):
    assert nearest.search(_table(spark, _rows(3)).limit(0)).count() == 0
    assert nearest.search(_table(spark, [(0, [1.0]), (1, None)])).count() == 0


def test_bounds_hold():
    random = np.random.default_rng(1)
    a, b = random.normal(size=(30, 64)), random.normal(size=(40, 64)) * 100
    (sa, ka, na, la), (sb, kb, nb, lb) = nearest._rounded(a), nearest._rounded(b)
    about = (sa.astype(float) @ sb.T.astype(float)) * ka[:, None] * kb[None, :]
    error = na[:, None] * lb[None, :] + la[:, None] * (nb + lb)[None, :]
    assert (np.abs(about - a @ b.T) <= error + 1e-9).all()


def test_rows_that_repeat_an_id_are_all_candidates(spark):
    rows = [(1, [0.5, 0.0]), (1, [0.9, 0.0]), (1, [0.9, 0.0]), (20, [1.0, 0.0]), (20, [2.0, 1.0]), (40, [1.0, 1.0])]
    found = _found(_table(spark, rows))
    assert found == _brute(rows) and [r[3] for r in found if r[0] == 40] == pytest.approx([3.0, 1.0, 0.9, 0.9, 0.5])


@pytest.mark.parametrize("large,small", [(1e160, 1e-160), (1e155, 1e-155), (1e300, 1.0), (1.0, 1e-310), (1e150, 1e-308)])
def test_no_neighbour_is_lost_to_overflow(large, small):
    random = np.random.default_rng(2)
    vectors = random.normal(size=(300, 8)) * np.where(random.random(300) < 0.5, large, small)[:, None]
    ids, queries = np.arange(300), np.arange(0, 300, 20)
    with np.errstate(all="ignore"):
        row, other, score = nearest.tile(queries, vectors[queries], ids, ids, vectors)
        for n, q in enumerate(queries):
            scores = nearest._dot(np.repeat(vectors[q][None], 300, 0), vectors)
            best = sorted((-s, c) for c, s in enumerate(scores) if c != q)[:20]
            assert list(zip((-score[row == n]).tolist(), other[row == n].tolist())) == best
