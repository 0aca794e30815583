import pytest
from test_sources import BAD_DATE, GOOD, HEADER, _file

from stockyard.functions.present import digits_of, report_view
from stockyard.operators import kpi, replenishment
from stockyard.plans import jobs
from stockyard.sources import files, tables

NEGATIVE = GOOD.replace("S001", "S002").replace("50.25", "-2.50")


def test_clean_then_load_then_publish(spark, tmp_path):
    raw = _file(tmp_path, HEADER, GOOD, NEGATIVE)
    summary = {r.check: r.result for r in jobs.clean_csv(spark, raw, str(tmp_path / "clean")).collect()}
    assert summary["Number of rows"] == 2 and summary["Negative demand forecasts"] == 0
    table = jobs.load_flat(spark, str(tmp_path / "clean"), "job_", (2, 15))
    assert sorted(str(r.demand_forecast) for r in table.collect()) == ["0.00", "50.25"]
    path = jobs.publish_reorder(table, str(tmp_path / "orders"))
    orders = spark.read.option("header", True).csv(path)
    assert orders.columns[:3] == ["Store ID", "Product ID", "Category"] and orders.count() == 2


def test_clean_reports_bad_dates(spark, tmp_path):
    raw = _file(tmp_path, HEADER, GOOD, BAD_DATE)
    summary = {r.check: r.result for r in jobs.clean_csv(spark, raw, str(tmp_path / "clean")).collect()}
    assert summary["Invalid dates"] == 1 and summary["Number of rows"] == 2


def test_load_star(spark, tmp_path):
    raw = _file(tmp_path, HEADER, GOOD, NEGATIVE)
    stored, report = jobs.load_star(spark, raw, "jobstar_")
    assert all(r.ok for r in report.collect())
    assert stored["inventory_sales_normalized"].count() == 2
    assert [r.store_id for r in stored["stores"].orderBy("store_id").collect()] == ["S001", "S002"]


def test_refused_lines_stop_the_load_or_are_reported(spark, tmp_path):
    raw = _file(tmp_path, HEADER, GOOD, NEGATIVE, BAD_DATE)
    with pytest.raises(tables.ConstraintError, match="1 refused"):
        jobs.load_star(spark, raw, "refused_")
    stored, report = jobs.load_star(spark, raw, "refused_", allow_refused=True)
    found = {r.check: (r.expected, r.actual, r.ok) for r in report.collect()}
    assert found["refused"] == (0, 1, False) and found["rows"] == (3, 2, False)
    assert stored["inventory_sales_normalized"].count() == 2


def test_loading_again_replaces(spark, tmp_path):
    place = str(tmp_path / "model")
    for _ in range(2):
        raw = _file(tmp_path, HEADER, GOOD, NEGATIVE)
        stored, report = jobs.load_star(spark, raw, "twice_", place)
        assert all(r.ok for r in report.collect())
        assert {n: f.count() for n, f in stored.items()} == {
            "stores": 2, "products": 1, "categories": 1, "regions": 1, "weather_conditions": 1, "seasons": 1,
            "promotions": 2, "inventory_sales_normalized": 2,
        }
        assert jobs.load_flat(spark, _file(tmp_path, HEADER, GOOD), "twice_", location=place).count() == 1


def test_prefixes_have_folders_of_their_own(spark, tmp_path):
    place = str(tmp_path / "shared")
    one, _ = jobs.load_star(spark, _file(tmp_path, HEADER, GOOD), "x_", place)
    two, _ = jobs.load_star(spark, _file(tmp_path, HEADER, GOOD.replace("P0001", "P0777")), "y_", place)
    assert [r.product_id for r in one["products"].collect()] == ["P0001"]
    assert [r.product_id for r in two["products"].collect()] == ["P0777"]


def test_loaded_table_is_pruned_by_month(spark, tmp_path):
    lines = [GOOD.replace("2023-05-01", f"2023-{m:02d}-{d:02d}") for m in range(1, 7) for d in (1, 20)]
    table = jobs.load_flat(spark, _file(tmp_path, HEADER, *lines), "months_")
    for report in (replenishment.reorder(table), replenishment.trend_reorder_point(table, days=30)):
        assert report.count() == 1
        plan = report._jdf.queryExecution().executedPlan().toString()
        filters = [x for x in plan.split("PartitionFilters: ")[1:]]
        assert filters and sum(not x.startswith("[isnotnull(date_month") for x in filters) <= plan.count("ReadSchema: struct<>")


def test_rounding_of_reports(facts):
    assert (digits_of("avg_price"), digits_of("overstock_pct"), digits_of("store_id")) == (2, 2, None)
    rows = facts({"inventory_level": 3, "units_sold": 1}, {"inventory_level": 3, "units_sold": 1}, {"inventory_level": 2, "units_sold": 0})
    row = report_view(kpi.performance(rows, ["store_id"])).first()
    assert (row.avg_inventory, row.inventory_turnover_proxy) == (2.67, 0.25)


def test_sql_over_loaded_tables(spark, facts):
    fact = facts({"region": "a"}, {"region": "b"})
    found = tables.table_query(spark, "SELECT COUNT(DISTINCT region) AS n FROM {fact}", fact=fact)
    assert found.first().n == 2
    assert files.CORRUPT not in fact.columns


def test_load_refuses_what_constraints_would(spark, tmp_path):
    table = jobs.load_flat(spark, _file(tmp_path, HEADER, GOOD), "kept_")
    with pytest.raises(tables.ConstraintError, match="repeated key"):
        jobs.load_flat(spark, _file(tmp_path, HEADER, GOOD, GOOD), "kept_")
    with pytest.raises(tables.ConstraintError, match="price"):
        jobs.load_flat(spark, _file(tmp_path, HEADER, GOOD.replace("10.00", "")), "kept_")
    with pytest.raises(tables.ShapeError):
        jobs.load_flat(spark, _file(tmp_path, HEADER, GOOD), "kept_", (2, 15))
    assert table.count() == 1


def test_sql_text_on_registered_views(spark, facts):
    fact = facts(*[{"product_id": f"P{i}", "units_sold": i} for i in range(6)])
    tables.register_views(inventory_sales=fact)
    text = """
        WITH m AS (SELECT product_id, AVG(units_sold) / NULLIF(AVG(inventory_level), 0) AS turnover
                   FROM inventory_sales GROUP BY product_id)
        SELECT tile, COUNT(*) AS n FROM (SELECT NTILE(3) OVER (ORDER BY turnover) AS tile FROM m) GROUP BY tile
    """
    assert sorted(map(tuple, tables.table_query(spark, text).collect())) == [(1, 2), (2, 2), (3, 2)]
