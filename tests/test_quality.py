import pandas as pd

from stockyard import schema as S
from stockyard.operators import quality


def test_null_and_missing_reports(facts):
    rows = facts({"region": None, "price": None}, {"region": None}, {})
    assert quality.null_counts(rows).first().null_region == 2
    report = quality.missing_report(rows).collect()
    assert [(r.column_name, r.missing_count) for r in report[:3]] == [("region", 2), ("price", 1), ("category", 0)]
    assert report[0].missing_percentage == 100.0 * 2 / 3
    assert len(report) == 15


def test_missing_report_of_empty_frame(facts):
    empty = facts({}).filter("1 = 0")
    assert {r.missing_percentage for r in quality.missing_report(empty).collect()} == {0.0}


def test_duplicates(facts):
    rows = facts({}, {}, {"inventory_level": 7}, {"store_id": "S002"}, {"store_id": "S003"}, {"store_id": "S003"})
    assert [(r.store_id, r.duplicate_count) for r in quality.duplicate_keys(rows).collect()] == [("S001", 3), ("S003", 2)]
    assert tuple(quality.duplicate_key_rows(rows).first()) == (5, 3)
    assert quality.duplicate_rows(rows).first()[0] == 2
    summary = quality.duplicate_summary(rows).first()
    assert tuple(summary) == (5, 3, 2)


def test_duplicates_count_nulls_as_equal(facts):
    rows = facts({"region": None}, {"region": None}, {"date": None}, {"date": None}, {"date": None})
    assert quality.duplicate_rows(rows).first()[0] == 3
    assert tuple(quality.duplicate_summary(rows).first()) == (5, 3, 3)
    assert tuple(quality.duplicate_summary(facts({}, {"store_id": "S9"})).first()) == (0, 0, 0)


def test_quality_summary(facts):
    rows = facts({"date": None, "demand_forecast": -1}, {"units_sold": -3}, {"units_sold": -3, "region": None})
    found = {r.check: r.result for r in quality.quality_summary(rows).collect()}
    assert found["Number of rows"] == 3 and found["Number of columns"] == 15
    assert found["Missing values"] == 2 and found["Invalid dates"] == 1
    assert found["Duplicate business keys"] == 1 and found["Duplicate rows"] == 0
    assert found["Negative units sold"] == 2 and found["Negative demand forecasts"] == 1
    assert found["Unique regions"] == 1 and found["Unique dates"] == 1


def test_describe_against_pandas(facts):
    values = [3, 3, 3, 8, 1, 400, 17, 17]
    rows = facts(*[{"units_sold": v, "demand_forecast": v + 0.25} for v in values])
    found = {r.column_name: r for r in quality.describe_numeric(rows, ["units_sold", "demand_forecast"]).collect()}
    for column, shift in (("units_sold", 0), ("demand_forecast", 0.25)):
        expected = (pd.Series(values) + shift).describe()
        row = found[column]
        got = [row["count"], row["mean"], row["std"], row["min"], row["p25"], row["p50"], row["p75"], row["max"]]
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, expected))


def test_describe_strings_ties(facts):
    rows = facts({"region": "b"}, {"region": "a"}, {"region": None})
    row = quality.describe_strings(rows, ["region"]).first()
    assert tuple(row) == ("region", 2, 2, "a", 1)


def test_outliers_are_strict(facts):
    # Quartiles 10 and 20: fences -5 and 35.
    values = [10, 10, 15, 20, 20, 35, 36, -5, -6]
    rows = facts(*[{"units_sold": v} for v in values])
    row = quality.iqr_outliers(rows, ["units_sold"]).first()
    q1, q3 = pd.Series(values).quantile([0.25, 0.75])
    assert (row.q1, row.q3) == (q1, q3)
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert row.outlier_count == sum(v < low or v > high for v in values)


def test_cardinality_exact_and_approximate(facts):
    rows = facts({"store_id": "a"}, {"store_id": "b"}, {"region": None})
    assert quality.cardinality(rows).first().asDict() == {"stores": 3, "products": 1, "categories": 1, "regions": 1}
    assert quality.cardinality(rows, approx=True).first().stores == 3


def test_functional_dependency(facts):
    rows = facts({"product_id": "p", "category": "a"}, {"product_id": "p", "category": "b"}, {"product_id": "q"})
    row = quality.functional_dependency(rows, ["product_id"], "category").first()
    assert (row.groups, row.violating_groups, row.min_values, row.max_values) == (2, 1, 1, 2)


def test_foreign_keys(spark, facts):
    fact = facts({"store_id": "a"}, {"store_id": "b"}, {"store_id": "b"})
    stores = spark.createDataFrame([("a",)], "store_id string")
    row = quality.foreign_key_check(fact, {"store_id": (stores, "store_id")}).first()
    assert (row.checked_rows, row.orphan_rows, row.orphan_values) == (3, 2, 1)
    assert quality.orphans(fact, stores, "store_id").count() == 2


def test_columns_by_type(facts):
    assert quality.columns_of_type(facts({}), "numeric") == S.NUMERIC_COLUMNS
    assert quality.columns_of_type(facts({}), "string") == S.STRING_COLUMNS


def test_profiles_against_pandas_with_missing_values(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    frame = pd.DataFrame({
        "three": [None if x % 7 == 0 else x / 1000 for x in range(2500)], "whole": rng.integers(-50, 50, 2500),
        "real": rng.normal(size=2500) * 1e6, "none": [None] * 2500,
    })
    rows = spark.createDataFrame(
        [(None if pd.isna(a) else f"{a:.3f}", int(b), float(c)) for a, b, c in frame[["three", "whole", "real"]].values.tolist()],
        "three string, whole bigint, real double",
    ).selectExpr("cast(three as decimal(12,3)) three", "whole", "real", "cast(null as decimal(9,1)) none")
    found = {r.column_name: r for r in quality.describe_numeric(rows, ["three", "whole", "real", "none"]).collect()}
    for column in ("three", "whole", "real"):
        expected = frame[column].astype(float).describe()
        row = found[column]
        got = [row["count"], row["mean"], row["std"], row["min"], row["p25"], row["p50"], row["p75"], row["max"]]
        assert np.allclose(got, expected, rtol=1e-9, atol=1e-9)
    assert tuple(found["none"])[1:] == (0, None, None, None, None, None, None, None)
    near = {r.column_name: r for r in quality.describe_numeric(rows, ["whole"], approximate=True).collect()}
    assert abs(near["whole"].p50 - found["whole"].p50) <= 1
    summary = {r.column_name: r for r in quality.numeric_summary(rows, ["three", "none"]).collect()}
    assert summary["none"].median is None and summary["three"].median == found["three"].p50


def test_small_values_keep_their_scale(spark):
    rows = spark.sql("SELECT cast(x AS decimal(10,3)) AS x FROM VALUES (0.001), (0.004) AS t(x)")
    row = quality.describe_numeric(rows, ["x"]).first()
    assert abs(row["mean"] - 0.0025) < 1e-12 and abs(row["std"] - pd.Series([0.001, 0.004]).std()) < 1e-12


def test_outlier_share_is_of_all_rows(facts):
    rows = facts(*[{"units_sold": v} for v in [1, 2, 2, 3, 2, 2, 1, 3, 500]], *[{"units_sold": None}] * 11)
    row = quality.iqr_outliers(rows, ["units_sold"]).first()
    assert (row.outlier_count, row.outlier_pct) == (1, 5.0)


def test_columns_without_values_stay_in_the_reports(facts):
    rows = facts({"region": None, "price": None}, {"region": None, "price": None})
    text = {r.column_name: tuple(r)[1:] for r in quality.describe_strings(rows, ["region", "category"]).collect()}
    assert text == {"region": (0, 0, None, None), "category": (2, 1, "Toys", 2)}
    row = quality.iqr_outliers(rows, ["price"]).first()
    assert (row.q1, row.outlier_count, row.outlier_pct) == (None, 0, 0.0)
    assert [r["count"] for r in quality.negative_forecast_described(rows).collect()] == [0, 0]


def test_summary_reads_twice_and_expands_no_rows(inventory):
    plan = quality.quality_summary(inventory.raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 2


def test_a_summary_without_deviations_adds_no_squares(spark):
    rows = spark.createDataFrame([(2**31 - 1,), (2**31 - 1,), (None,), (-(2**31),)], "x int")
    found = quality.numeric_summary(rows, ["x"])
    assert "_sq0" not in found._jdf.queryExecution().analyzed().toString()
    assert found.first()[1:] == (-(2.0**31), 2.0**31 - 1, (2**31 - 2) / 3, 2.0**31 - 1)
