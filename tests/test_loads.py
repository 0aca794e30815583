"""Loads that are checked before they show, and keys that last."""

import pytest
from test_sources import GOOD, HEADER, _file

from stockyard.operators import star
from stockyard.plans import jobs
from stockyard.sources import tables

MODE = "spark.sql.sources.partitionOverwriteMode"


@pytest.fixture(params=["static", "dynamic"])
def overwrite_mode(spark, request):
    before = spark.conf.get(MODE)
    spark.conf.set(MODE, request.param)
    yield request.param
    spark.conf.set(MODE, before)


def _table(spark, prefix):
    return tables.create_tables(spark, ["inventory_sales"], prefix=prefix)["inventory_sales"]


def _dates(spark, table):
    return sorted(str(r["date"]) for r in spark.table(table).collect())


def test_a_load_replaces_all_months(spark, facts, overwrite_mode):
    table = _table(spark, f"all_{overwrite_mode}_")
    tables.load_fact(facts({"date": "2023-01-01"}, {"date": "2023-02-01"}), table)
    tables.load_fact(facts({"date": "2023-02-02"}), table)
    assert _dates(spark, table) == ["2023-02-02"]
    tables.load_fact(facts(), table, expected_rows=0)
    assert _dates(spark, table) == []


@pytest.mark.parametrize("broken", ["count", "key", "missing", "own check", "task"])
def test_a_refused_load_leaves_the_old_rows(spark, facts, overwrite_mode, broken):
    table = _table(spark, f"refused_{overwrite_mode}_{broken.replace(' ', '_')}_")
    tables.load_fact(facts({"date": "2023-01-01"}, {"date": "2023-02-01"}), table)
    rows, options = facts({"date": "2023-02-01"}, {"date": "2023-03-01"}), {}
    if broken == "count":
        options = {"expected_rows": 3}
    elif broken == "key":
        rows = rows.unionAll(rows)
    elif broken == "missing":
        rows = facts({"price": None})
    elif broken == "own check":
        options = {"checks": [lambda written: 1 // (written.count() - 2)]}
    else:
        rows = rows.selectExpr("*").withColumn("region", tables.F.raise_error(tables.F.lit("lost")).cast("string"))
    with pytest.raises(Exception):
        tables.load_fact(rows, table, **options)
    assert _dates(spark, table) == ["2023-01-01", "2023-02-01"]
    tables.load_fact(facts({"date": "2023-04-01"}), table, 1)
    assert _dates(spark, table) == ["2023-04-01"]


def test_the_version_before_can_be_restored(spark, facts):
    table = _table(spark, "versions_")
    for day in ("2023-01-01", "2023-02-01", "2023-03-01"):
        tables.load_fact(facts({"date": day}), table)
    held = spark.table(table)
    tables.restore(spark, table)
    assert _dates(spark, table) == ["2023-02-01"]
    tables.restore(spark, table)
    assert _dates(spark, table) == ["2023-03-01"] == [str(r["date"]) for r in held.collect()]
    assert tables.drop_older(spark, table) == 1 and tables.drop_older(spark, table) == 0
    tables.restore(spark, table)
    assert _dates(spark, table) == ["2023-02-01"]
    with pytest.raises(ValueError):
        tables.restore(spark, _table(spark, "unloaded_"))


def test_a_staged_version_is_not_seen_before_the_switch(spark, facts):
    table = _table(spark, "staged_")
    tables.load_fact(facts({"date": "2023-01-01"}), table)
    version = tables.stage(facts({"date": "2023-05-05"}), table)
    assert _dates(spark, table) == ["2023-01-01"] and version.rows.count() == 1
    tables.switch(spark, version)
    assert _dates(spark, table) == ["2023-05-05"]


def test_written_types_are_those_of_the_table(spark, facts):
    table = _table(spark, "types_")
    tables.load_fact(facts({}).withColumn("units_sold", tables.F.lit(7).cast("bigint")), table)
    assert spark.table(table).schema["units_sold"].dataType.simpleString() == "int"
    with pytest.raises(Exception):
        tables.load_fact(facts({}).withColumn("units_sold", tables.F.lit(1 << 40)), table)
    assert spark.table(table).first().units_sold == 7


def _ids(frame):
    return {r.category_name: r.category_id for r in frame.collect()}


def test_merged_dimensions_keep_ids(facts):
    first = star.build_dimensions(facts({"category": "m"}, {"category": "k"}, {"category": None}))
    assert _ids(first["categories"]) == {"k": 1, "m": 2}
    rows = facts({"category": "a", "store_id": "S9"}, {"category": "m"}, {"category": "l"}, {"category": "a"})
    second = star.merge_dimensions(rows, first)
    assert _ids(second["categories"]) == {"k": 1, "m": 2, "a": 3, "l": 4}
    assert sorted(r.store_id for r in second["stores"].collect()) == ["S001", "S9"]
    third = star.merge_dimensions(facts(), second)
    assert _ids(third["categories"]) == _ids(second["categories"])
    partly = star.merge_dimensions(rows, {"categories": first["categories"].filter("category_id = 2")})
    assert _ids(partly["categories"]) == {"m": 2, "a": 3, "l": 4}


def test_names_of_all_columns_from_one_scan(facts):
    rows = facts({"category": "x", "region": "x"}, {"category": "y", "region": None, "store_id": "x"})
    found = sorted(tuple(r) for r in star.names(rows).collect() if r.table in ("categories", "regions", "stores"))
    assert found == [("categories", "x"), ("categories", "y"), ("regions", "x"), ("stores", "S001"), ("stores", "x")]
    assert star.names(rows)._jdf.queryExecution().executedPlan().toString().count("Scan") == 1


def test_a_second_load_of_the_star_keeps_every_id(spark, tmp_path):
    line = GOOD.replace('"Toys, Games"', "{}").replace("P0001", "{}").format
    one, _ = jobs.load_star(spark, _file(tmp_path, HEADER, line("P1", "LARGE"), line("P2", "SMALL")), "lasting_")
    assert _ids(one["categories"]) == {"LARGE": 1, "SMALL": 2}
    two, report = jobs.load_star(spark, _file(tmp_path, HEADER, line("P1", "ANY"), line("P3", "SMALL")), "lasting_")
    assert _ids(two["categories"]) == {"LARGE": 1, "SMALL": 2, "ANY": 3}
    assert sorted((r.product_id, r.category_id) for r in two["inventory_sales_normalized"].collect()) == [("P1", 3), ("P3", 2)]
    assert {r.check: r.ok for r in report.collect()} == {"rows": True, "categories": True, "refused": True}


def test_a_refused_star_load_changes_no_table(spark, tmp_path):
    stored, _ = jobs.load_star(spark, _file(tmp_path, HEADER, GOOD), "unchanged_")
    before = {n: sorted(map(str, f.collect())) for n, f in stored.items()}
    with pytest.raises(tables.ConstraintError, match="repeated key"):
        jobs.load_star(spark, _file(tmp_path, HEADER, GOOD.replace("Toys", "New"), GOOD), "unchanged_")
    assert before == {n: sorted(map(str, spark.table(f"unchanged_{n}").collect())) for n in stored}


def test_references_without_a_target_stop_the_load(spark, facts):
    jobs.store_star(facts({}), "targets_")
    with pytest.raises(tables.ConstraintError, match="promotion_id"):
        jobs.store_star(facts({"holiday_promotion": 5}), "targets_")
    assert spark.table("targets_inventory_sales_normalized").first().promotion_id == 0
