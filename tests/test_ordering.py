"""Distributed order statistics against brute force, with hot values."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stockyard.operators import movement, ordering


def _values(kind, n, rng):
    if kind == "hot":
        return [7 if rng.random() < 0.4 else rng.randint(0, 1000) for _ in range(n)]
    if kind == "constant":
        return [5] * n
    return [rng.randint(-500, 500) for _ in range(n)]


@pytest.mark.parametrize("kind,n", [("hot", 5000), ("constant", 100), ("plain", 1), ("plain", 2), ("plain", 999)])
def test_quantiles(spark, kind, n):
    rng = random.Random(n)
    data = pd.DataFrame({"a": _values(kind, n, rng), "b": [v / 100 for v in _values("plain", n, rng)]})
    probabilities = [0.0, 0.25, 1 / 3, 0.5, 0.75, 1.0]
    found = {
        r["name"]: list(r)[1:]
        for r in ordering.column_quantiles(spark.createDataFrame(data), ["a", "b"], probabilities).collect()
    }
    for column in ("a", "b"):
        assert np.allclose(found[column], np.quantile(data[column], probabilities), rtol=0, atol=1e-9)


def test_quantiles_skip_missing(spark):
    frame = spark.createDataFrame([(1,), (None,), (3,)], "a int")
    assert ordering.column_quantiles(frame, ["a"], [0.5]).first().q0 == 2.0


def test_whole_numbers_and_decimals_are_bracketed_by_the_quicker_sketch(spark, monkeypatch):
    n = 60_000  # more than a sketch keeps
    rows = spark.range(0, n, 1, 4).selectExpr(
        "cast(id * 7919 % 60000 as int) a", "cast(id * 7919 % 60000 as decimal(12,2)) / 100 b", "cast(null as int) c"
    )
    monkeypatch.setattr(ordering.F, "percentile_approx", lambda *a: pytest.fail("the slower sketch"))
    found = {r["name"]: (r.q0, r.q1) for r in ordering.column_quantiles(rows, ["a", "b", "c"], [0.25, 0.5]).collect()}
    assert set(found) == {"a", "b"}
    assert found["a"] == ((n - 1) / 4, (n - 1) / 2)
    assert np.allclose(found["b"], [(n - 1) / 400, (n - 1) / 200], rtol=0, atol=1e-9)


def test_a_value_that_is_no_number_counts_as_the_largest(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (3.0,), (float("nan"),)], "a double")
    assert ordering.column_quantiles(rows, ["a"], [0.25, 0.5]).first()[1:] == (2.0, 3.0)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 20, 1000])
def test_ntile_matches_sql(spark, n):
    rng = random.Random(n)
    frame = spark.createDataFrame([(i, rng.randint(0, 5)) for i in range(n)], "id int, v int")
    frame = frame.repartition(5)
    found = {r.id: r.tile for r in ordering.ntile(frame, 3, ["v", "id"]).collect()}
    frame.createOrReplaceTempView("ntile_input")
    expected = spark.sql("select id, ntile(3) over (order by v, id) t from ntile_input").collect()
    assert found == {r.id: r.t for r in expected}


def test_running_total(spark):
    rng = random.Random(3)
    data = pd.DataFrame({"k": range(3000), "w": [rng.randint(0, 9) for _ in range(3000)]})
    shuffled = spark.createDataFrame(data.sample(frac=1, random_state=1)).repartition(11)
    found = ordering.running_total(shuffled, ["k"], weight="w", into="t").orderBy("k").toPandas()
    assert (found["t"].to_numpy() == data["w"].cumsum().to_numpy()).all()
    assert set(found["grand_total"]) == {data["w"].sum()}
    down = ordering.running_total(shuffled, [("k", "desc")], weight="w", into="t").orderBy("k").toPandas()
    assert (down["t"].to_numpy() == data["w"][::-1].cumsum()[::-1].to_numpy()).all()


def test_first_per_key_limits_before_the_shuffle(spark):
    frame = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    kept = ordering.first_per_key(frame, ["k"], ["v"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan and "row_number(), 1, Final" in plan
    assert sorted(map(tuple, kept.collect())) == [(0, 0), (1, 1), (2, 2)]


def test_least_per_key_keeps_the_candidates(spark):
    frame = spark.createDataFrame(
        [("a", 2, 1), ("a", 1, 3), ("a", 1, 2), ("b", 5, 1), ("b", None, 9), ("b", None, 8), (None, 4, 1), (None, 3, 1)],
        "k string, v int, w int",
    )
    for bound in (ordering.BROADCAST_KEYS, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(ordering, "BROADCAST_KEYS", bound)
            near = ordering.least_per_key(frame, ["k"], "v")
        assert near.columns == frame.columns
        assert sorted(map(tuple, near.collect()), key=str) == sorted(
            [("a", 1, 3), ("a", 1, 2), ("b", None, 9), ("b", None, 8), (None, 3, 1)], key=str
        )
        first = ordering.first_per_key(near, ["k"], ["v", "w"]).collect()
        assert sorted(first, key=str) == sorted(ordering.first_per_key(frame, ["k"], ["v", "w"]).collect(), key=str)


def test_twenty_products_split_7_6_7_and_7_7_6(facts):
    rows = facts(
        *[{"product_id": f"P{i:04d}", "units_sold": 100 + i, "inventory_level": 1000} for i in range(20)]
    )
    for method, sizes in (("ntile", [7, 7, 6]), ("quantile", [7, 6, 7])):
        counted = movement.segments(rows, method=method).groupBy("movement_segment").count().collect()
        found = {r["movement_segment"]: r["count"] for r in counted}
        assert [found[s] for s in ("Slow-moving", "Medium-moving", "Fast-moving")] == sizes


def test_equal_turnover(facts):
    rows = facts(*[{"product_id": f"P{i}"} for i in range(6)])
    tiles = movement.segments(rows).groupBy("movement_segment").count().collect()
    assert sorted(r["count"] for r in tiles) == [2, 2, 2]
    bins = movement.segments(rows, method="quantile").groupBy("movement_segment").count().collect()
    assert [tuple(r) for r in bins] == [("Slow-moving", 6)]


def test_watchlists(facts):
    rows = facts(
        *[
            {"product_id": f"P{i}", "units_sold": 10 * i, "inventory_level": 100 + i, "demand_forecast": 300 if i == 8 else 5}
            for i in range(9)
        ]
    )
    segmented = movement.segments(rows)
    assert movement.watchlist(segmented, "replenish", 1).first().product_id == "P8"
    assert [r.product_id for r in movement.watchlist(segmented, "tied_up", 2).collect()] == ["P2", "P1"]


def test_bubble_sizes_span(facts):
    rows = facts({"product_id": "a", "units_sold": 1}, {"product_id": "b", "units_sold": 3}, {"product_id": "c", "units_sold": 2})
    assert [r.bubble_size for r in movement.bubble_sizes(rows).collect()] == [200.0, 2000.0, 1100.0]
    flat = movement.bubble_sizes(facts({"product_id": "a"}, {"product_id": "b"}))
    assert [r.bubble_size for r in flat.collect()] == [None, None]


def test_approximate_quantiles_are_near(spark):
    frame = spark.range(10_001).select(F.col("id").alias("a"), (F.col("id") / 100).alias("b"))
    rows = {r["name"]: r for r in ordering.approximate_quantiles(frame, ["a", "b"], [0.25, 0.5]).collect()}
    assert abs(rows["a"].q0 - 2500) <= 5 and abs(rows["a"].q1 - 5000) <= 5
    assert abs(rows["b"].q1 - 50) <= 0.05
