import pytest
from pyspark.sql import functions as F

from stockyard import schema as S
from stockyard.operators import kpi, reshape, snapshot
from stockyard.sources import files, tables

HEADER = ",".join(header for header, _, _ in S.CSV_COLUMNS)
GOOD = '2023-05-01,S001,P0001,"Toys, Games",North,100,10,20,50.25,10.00,5,Sunny,1,9.50,Spring'
BAD_DATE = '2023-13-01,S001,P0002,Toys,North,100,10,20,-3.00,10.00,5,Sunny,0,9.50,Spring'


def _file(tmp_path, *lines):
    path = tmp_path / "in.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_titled_csv(spark, tmp_path):
    row = files.read_csv(spark, _file(tmp_path, HEADER, GOOD)).first()
    assert row.category == "Toys, Games" and str(row.demand_forecast) == "50.25" and str(row.date) == "2023-05-01"


def test_bad_date_fails_or_is_kept_apart(spark, tmp_path):
    path = _file(tmp_path, HEADER, GOOD, BAD_DATE)
    with pytest.raises(Exception):
        files.read_csv(spark, path).collect()
    assert files.read_csv(spark, path, text_dates=True).count() == 2
    staged = files.bulk_load(spark, path)
    bad = staged.filter(F.col(files.CORRUPT).isNotNull())
    assert bad.count() == 1
    assert bad.select("product_id", files.CORRUPT).first() == ("P0002", BAD_DATE)


def test_other_header_is_refused(spark, tmp_path):
    path = _file(tmp_path, HEADER.replace("Region", "Zone"), GOOD)
    with pytest.raises(Exception):
        files.read_csv(spark, path).collect()


def test_other_separator_and_quote(spark, tmp_path):
    path = _file(tmp_path, HEADER.replace(",", ";"), GOOD.replace('"', "'").replace("Toys, Games", "Toys! Games").replace(",", ";").replace("!", ";"))
    row = files.bulk_load(spark, path, sep=";", quote="'").first()
    assert row.category == "Toys; Games"


def test_csv_round_trip(spark, facts, tmp_path):
    rows = facts({"category": 'a "b", c'}, {"store_id": "S002", "demand_forecast": 0})
    path = files.write_csv(rows, str(tmp_path / "out"))
    assert sorted(files.read_csv(spark, path).collect()) == sorted(rows.collect())


def test_load_fact_checks_the_count(spark, facts):
    rows = facts({}, {"store_id": "S002"})
    table = tables.create_tables(spark, ["inventory_sales"], prefix="t_")["inventory_sales"]
    assert tables.load_fact(rows, table, 2) == 2
    assert tables.load_fact(rows, table, 2) == 2  # overwrite, not append
    with pytest.raises(tables.ShapeError):
        tables.load_fact(rows, table, 3)


def test_input_shape(facts):
    rows = facts({})
    assert tables.check_input_shape(rows, 1, 15) is rows
    with pytest.raises(tables.ShapeError):
        tables.check_input_shape(rows, 2, 15)


def test_table_query_over_a_stored_table(spark, facts):
    table = tables.create_tables(spark, ["inventory_sales"], prefix="q_")["inventory_sales"]
    tables.load_fact(facts({"units_sold": 4}, {"units_sold": 5, "store_id": "S2"}), table)
    assert tables.table_query(spark, f"SELECT SUM(units_sold) AS n FROM {table}").first().n == 9


@pytest.mark.parametrize("grain", list(S.GRAINS))
def test_partitioned_fact_prunes_the_snapshot(spark, facts, tmp_path, grain):
    rows = facts({"date": "2022-12-31"}, {"date": "2023-01-01"}, {"date": "2023-05-01"}, {"date": "2023-05-02"})
    path = tables.write_partitioned(rows, str(tmp_path / "fact"), grain)
    stored = tables.read_partitioned(spark, path, grain)
    latest = snapshot.latest_snapshot(stored)
    assert [str(r.date) for r in latest.collect()] == ["2023-05-02"]
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({grain}" in plan
    window = snapshot.trailing_window(stored, 122)
    assert [str(r.date) for r in window.orderBy("date").collect()] == ["2023-01-01", "2023-05-01", "2023-05-02"]
    older = snapshot.trailing_window(stored, 2, as_of="2023-01-02")
    assert [str(r.date) for r in older.orderBy("date").collect()] == ["2023-01-01"]


def test_scan_reads_only_what_a_report_needs(inventory):
    plan = kpi.risk_by(inventory.fact, ["store_id"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<store_id:string,inventory_level:int,demand_forecast:decimal(10,2)>" in plan
    assert "GreaterThan(demand_forecast,0" in plan


def test_no_query_crosses_rows(inventory):
    from stockyard.plans import queries

    for name in ("store_efficiency", "min_max_scale", "trend_reorder_point", "movement_segments", "iqr_outliers"):
        plan = queries.catalog()[name](inventory)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_reshape(facts):
    rows = facts(
        {"store_id": "a", "category": "x", "units_sold": 4}, {"store_id": "a", "category": "x", "units_sold": 8},
        {"store_id": "b", "category": "y", "units_sold": 1},
    )
    for columns in (None, ["x", "y"]):
        assert [tuple(r) for r in reshape.pivot_mean(rows, "store_id", "category", columns=columns).collect()] == [
            ("a", 6.0, None), ("b", None, 1.0),
        ]
    seasons = [r.seasonality for r in reshape.pivot_season_category(rows).collect()]
    assert seasons == ["Spring", "Summer", "Autumn", "Winter"]
    assert reshape.select_where(rows, category="x", store_id="All").count() == 2
    assert reshape.with_label(rows).filter("label = 'b · P0001'").count() == 1
    assert reshape.max_of_columns(rows).first()[0] == 100.0
    assert reshape.sample_rows(rows, 2).count() == 2
    assert reshape.sample_rows(rows, 10).count() == 3
    crosstab = reshape.crosstab_status(rows).collect()
    assert [tuple(r) for r in crosstab] == [("a", 0, 0, 0, 2), ("b", 0, 0, 0, 1)]
