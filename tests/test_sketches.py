"""Summaries by period: exact where they must be, near where they may be."""

import random

import pytest
from pyspark.sql import functions as F

from stockyard import schema as S
from stockyard.operators import ordering, quality, sketches


@pytest.fixture(scope="module")
def stored(spark, inventory, tmp_path_factory):
    return sketches.store(inventory.fact, str(tmp_path_factory.mktemp("sketches") / "s"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()]


@pytest.mark.parametrize("span", [(None, None), ("1994-01-01", "1994-12-01"), ("1998-01-01", None), (None, "1992-02-01")])
def test_profile_of_a_period_is_exact(spark, inventory, stored, span):
    rows = sketches.of_periods(inventory.fact, *span)
    found = sketches.describe(rows, sketches.read(spark, stored, *span))
    assert _rows(found) == _rows(quality.describe_numeric(rows))


def test_no_job_before_the_frame_and_each_column_read_once(spark, inventory, stored):
    summaries = sketches.read(spark, stored)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "building the frame")
    found = sketches.describe(inventory.fact, summaries)
    jobs = tracker.getJobIdsForGroup("plan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(jobs) == []
    scans = [s for s in _plan(found).split("FileScan parquet ")[1:] if "date_month" in s.split("Location")[0]]
    assert len(scans) <= len(S.NUMERIC_COLUMNS)
    assert all(s.split("ReadSchema: struct<")[1].split(">")[0].count(":") == 1 for s in scans)


def test_other_months_are_not_read(inventory):
    rows = sketches.of_periods(inventory.fact, "1994-01-01", "1994-12-01")
    assert "PartitionFilters: [isnotnull(date_month" in _plan(rows.select("price"))


def test_brackets_that_miss_raise(spark):
    rows = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    good = ordering.bracketed_quantiles(rows, ["x"], [0.5], [[F.lit(490.0), F.lit(510.0)]])
    assert good.first().q0 == 499.5
    with pytest.raises(Exception, match="misses its quantile"):
        ordering.bracketed_quantiles(rows, ["x"], [0.5], [[F.lit(600.0), F.lit(700.0)]]).collect()


def test_quantiles_of_hot_values_and_missing_ones(spark, facts, tmp_path):
    draw = random.Random(3)
    values = [7] * 400 + [draw.randrange(1000) for _ in range(600)]
    rows = facts(*[{"units_sold": v, "inventory_level": None, "date": f"2023-0{1 + i % 3}-01"} for i, v in enumerate(values)])
    summaries = sketches.read(spark, sketches.store(rows, str(tmp_path / "s")))
    found = {r.column_name: r for r in sketches.describe(rows, summaries).collect()}
    exact = {r.column_name: r for r in quality.describe_numeric(rows).collect()}
    assert found["units_sold"] == exact["units_sold"] and found["inventory_level"]["count"] == 0
    assert found["inventory_level"].p50 is None is found["inventory_level"].mean


def test_refreshing_a_period_replaces_its_row_alone(spark, facts, tmp_path):
    old = facts({"date": "2023-01-05", "units_sold": 1}, {"date": "2023-02-05", "units_sold": 2}, {"date": "2023-03-05"})
    path = sketches.store(old, str(tmp_path / "s"))
    new = facts({"date": "2023-01-05", "units_sold": 1}, {"date": "2023-02-05", "units_sold": 20}, {"date": "2023-02-06", "units_sold": 30})
    sketches.refresh(new, path, ["2023-02-01", "2023-03-01"])
    found = sketches.describe(new, sketches.read(spark, path))
    assert _rows(found) == _rows(quality.describe_numeric(new))
    assert {str(r.period): r.rows for r in sketches.read(spark, path).collect()} == {"2023-01-01": 1, "2023-02-01": 2, "2023-03-01": 0}


def test_distinct_estimates_merge_within_their_error(spark, tmp_path):
    folder = "/root/testdata/sf0.1"
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.col("l_shipdate").cast("date").alias("date"), F.col("l_orderkey").cast("string").alias("order"),
        F.col("l_partkey").cast("string").alias("part"),
    )
    summaries = sketches.read(spark, sketches.store(lines, str(tmp_path / "s"), [], ["order", "part"], "date_year"))
    found = {r.column_name: r.distinct_estimate for r in sketches.distinct_estimates(summaries, ["order", "part"]).collect()}
    exact = lines.agg(F.count_distinct("order").alias("order"), F.count_distinct("part").alias("part")).first()
    for column, estimate in found.items():
        assert abs(estimate - exact[column]) <= 4 * sketches.HLL_ERROR * exact[column]
    # a union is not a sum: most orders have lines in one year, parts in all
    parts = sum(r.n for r in summaries.select(F.hll_sketch_estimate("hll_part").alias("n")).collect())
    assert parts > 3 * exact["part"]


def test_frequent_values_are_the_top_of_value_counts(spark, inventory):
    found = sketches.frequent_values(inventory.fact, ["category", "product_id"], k=5)
    for column in ("category", "product_id"):
        top = [(r[column], r.observations) for r in quality.value_counts(inventory.fact, column).limit(5).collect()]
        assert [(r.column_value, r.observations) for r in found.filter(F.col("column_name") == column).collect()] == top


def test_frequent_values_among_very_many(spark):
    # 60 000 values that occur once or twice, and ten that occur often
    rare = spark.range(90_000).select(F.concat(F.lit("r"), (F.col("id") % 60_000).cast("string")).alias("v"))
    often = spark.range(55).select(F.explode(F.sequence(F.lit(1), F.col("id") % 10 * 300 + 300)).alias("n"), "id")
    rows = rare.unionAll(often.select(F.concat(F.lit("o"), (F.col("id") % 10).cast("string")).alias("v")))
    rows = rows.repartition(8, F.rand(1))
    found = sketches.frequent_values(rows, ["v"], k=12, tracked=2048, candidates=64).collect()
    exact = [(r.v, r.observations) for r in quality.value_counts(rows, "v").limit(10).collect()]
    assert [(r.column_value, r.observations) for r in found][:10] == exact
    assert [r.certain for r in found][:10] == [True] * 10 and not any(r.certain for r in found[10:])


def test_frequent_values_without_values(facts):
    assert sketches.frequent_values(facts(), ["category"]).collect() == []
    assert sketches.frequent_values(facts({"category": None}), ["category"]).collect() == []
