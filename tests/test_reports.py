"""Reports over every day, every slice, two dates, and the calendar."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from stockyard.operators import gaps, kpi, snapshot
from stockyard.operators import replenishment as R
from stockyard.sources import tables

SHORT = {"inventory_level": 10, "demand_forecast": 50}
PAIR = ["store_id", "product_id"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- the reorder point of every day -----------------------------------------


@pytest.fixture(scope="module")
def sales(facts):
    """A pair with rows on most days of 900, one with few, one with a value missing."""
    start, rows = datetime.date(2021, 11, 3), []
    for n in range(900):
        if n % 7 != 3 and not 400 <= n < 560:
            rows.append({"date": start + datetime.timedelta(n), "store_id": "S1", "units_sold": n * n % 53, "inventory_level": n % 61})
    for n in (0, 88, 89, 90, 91, 180, 500):
        rows.append({"date": start + datetime.timedelta(n), "store_id": "S2", "units_sold": n})
    rows.append({"date": start, "store_id": "S3", "units_sold": None})
    return rows


def _history(rows, days):
    found = {}
    for row in rows:
        window = [
            r["units_sold"] for r in rows
            if r["store_id"] == row["store_id"] and 0 <= (row["date"] - r["date"]).days < days
        ]
        sold = [x for x in window if x is not None]
        mean = sum(sold) / len(sold) if sold else None
        spread = math.sqrt(sum((x - mean) ** 2 for x in sold) / len(sold)) if sold else None
        found[row["store_id"], row["date"]] = (len(window), mean, spread)
    return found


@pytest.mark.parametrize("days,chunk", [(90, 360), (90, 30), (7, 100), (1, 360)])
def test_history_is_that_of_a_plain_scan(facts, sales, days, chunk):
    expected = _history(sales, days)
    found = R.reorder_point_history(facts(*sales), days=days, chunk=chunk).collect()
    assert len(found) == len(sales)
    for r in found:
        n, mean, spread = expected[r.store_id, r.date]
        assert r.days_observed == n
        assert (r.avg_daily_sales_90d, r.stddev_daily_sales_90d) == (
            (None, None) if mean is None else (pytest.approx(mean), pytest.approx(spread, abs=1e-6))
        )


def test_every_day_of_the_history_is_the_trend_of_that_day(inventory):
    history = R.reorder_point_history(inventory.fact)
    for day in (None, "1995-06-17", "1992-02-01"):
        date = inventory.fact.agg(F.max("date")).first()[0] if day is None else datetime.date.fromisoformat(day)
        trend = R.trend_reorder_point(inventory.fact, as_of=day)
        same = history.filter(F.col("date") == date).select(*trend.columns)
        assert sorted(map(str, same.collect())) == sorted(map(str, trend.collect()))


def test_history_takes_one_shuffle(inventory):
    assert _plan(R.reorder_point_history(inventory.fact)).count("Exchange") == 1


# --- changes between two order lists ----------------------------------------


def _changes(df, **options):
    return [
        (r.store_id, r.change, r.order_qty_before, r.order_qty_now, r.order_qty_change)
        for r in R.reorder_changes(df, **options).collect()
    ]


@pytest.fixture
def two_days(facts):
    old, new = {"date": "2023-04-28"}, {"date": "2023-05-01"}
    return facts(
        {**old, **SHORT, "store_id": "gone"}, {**old, **SHORT, "store_id": "same"}, {**old, **SHORT, "store_id": "more"},
        {**old, **SHORT, "store_id": None}, {**old, "store_id": "new"}, {**old, **SHORT, "store_id": "absent"},
        {**new, "store_id": "gone"}, {**new, **SHORT, "store_id": "same"}, {**new, **SHORT, "inventory_level": 4, "store_id": "more"},
        {**new, **SHORT, "store_id": None, "inventory_level": 20}, {**new, **SHORT, "store_id": "new"},
        {"date": "2023-03-01", **SHORT, "store_id": "older"},
    )


def test_changes_between_two_dates(two_days):
    expected = [
        ("new", "New", None, 45, 45), (None, "Changed", 45, 35, -10), ("more", "Changed", 45, 51, 6),
        ("absent", "Withdrawn", 45, None, -45), ("gone", "Withdrawn", 45, None, -45),
    ]
    assert _changes(two_days) == expected
    assert _changes(two_days, as_of="2023-05-01", since="2023-04-28") == expected
    kept = [c for c in _changes(two_days, all_rows=True) if c not in expected]
    assert kept == [("same", "Unchanged", 45, 45, 0)]
    totals = {r.change: (r.combinations, r.units_change) for r in R.reorder_change_totals(two_days).collect()}
    assert totals == {"New": (1, 45), "Changed": (2, -4), "Unchanged": (1, 0), "Withdrawn": (2, -90)}


def test_dates_without_rows_count_as_empty_lists(facts, two_days):
    assert {c[1] for c in _changes(two_days, as_of="2023-05-01", since="2020-01-01")} == {"New"}
    assert {c[1] for c in _changes(two_days, as_of="2024-01-01", since="2023-05-01")} == {"Withdrawn"}
    assert _changes(facts()) == []
    assert [c[1] for c in _changes(facts({**SHORT, "store_id": "only"}))] == ["New"]


def test_only_the_periods_of_the_two_dates_are_read(spark, two_days, tmp_path):
    path = tables.write_partitioned(two_days, str(tmp_path / "fact"))
    stored = tables.read_partitioned(spark, path)
    assert _changes(stored) == _changes(two_days)
    assert stored.agg(snapshot.previous_date(stored).alias("d")).first().d == datetime.date(2023, 4, 28)
    scans = _plan(R.reorder_changes(stored)).split("PartitionFilters: ")[1:]
    # what reads columns of rows is pruned; the newest month alone is sought among all
    assert all(s.startswith("[isnotnull(date_month") for s in scans if "ReadSchema: struct<>" not in s.split("\n")[0])


# --- every slice in one pass ------------------------------------------------


def test_slices_are_the_single_reports(inventory):
    found = kpi.cube(inventory.fact).collect()
    for (column,) in kpi.SLICES:
        rows = {r[column]: r for r in found if r["slice"] == column}
        single = kpi.performance(inventory.fact, [column]).collect()
        assert len(single) == len(rows)
        for r in single:
            assert all(rows[r[column]][c] == r[c] for c in kpi.PERFORMANCE)
        risks = kpi.risk_by(inventory.fact, [column]).collect()
        assert len(risks) == sum(r["valid_observations"] > 0 for r in rows.values())
        for r in risks:
            assert all(rows[r[column]][c] == r[c] for c in kpi.SEGMENT_RISK)


def test_cube_scans_once_and_adds_up_sums(inventory):
    plan = _plan(kpi.cube(inventory.fact))
    assert plan.count("FileScan") == 1 and "Expand" in plan
    # the rows are aggregated before the sets multiply them
    assert plan.index("Expand") < plan.rindex("HashAggregate") < plan.index("FileScan")


def test_cube_of_missing_values_and_empty_rows(facts):
    rows = facts(
        {"store_id": None, "units_sold": 3}, {"store_id": None, "category": "x", "units_sold": 4},
        {"category": "x", "demand_forecast": 0, "inventory_level": None}, {"region": None, "units_sold": None},
    )
    found = {(r["slice"], r.store_id, r.category): r for r in kpi.cube(rows, [("store_id",), ("category",), ()]).collect()}
    assert found["store_id", None, None].total_units_sold == 7
    assert found["category", None, "x"].valid_observations == 1
    network = found["network", None, None]
    assert network.total_units_sold == 17 and network.avg_inventory == 100.0 and network.valid_observations == 3
    assert kpi.cube(facts()).collect() == []


# --- calendar ---------------------------------------------------------------


def _day(n):
    return datetime.date(2023, 1, 1) + datetime.timedelta(n)


def test_gaps_and_islands(facts):
    days = {"a": [0, 1, 1, 4, 5, 6, 20], "b": [3], None: [0, 2]}
    rows = facts(*[{"store_id": s, "date": _day(n)} for s, ns in days.items() for n in ns], {"date": None, "store_id": "a"})
    found = [(r.store_id, r.gap_start, r.gap_end, r.missing_days) for r in gaps.date_gaps(rows).collect()]
    assert found == [("a", _day(7), _day(19), 13), ("a", _day(2), _day(3), 2), (None, _day(1), _day(1), 1)]
    assert [r.missing_days for r in gaps.date_gaps(rows, longer_than=2).collect()] == [13]
    islands = [(r.store_id, r.island_start, r.island_end, r.days) for r in gaps.date_islands(rows, ["store_id"]).collect()]
    assert islands == [
        ("a", _day(4), _day(6), 3), ("a", _day(0), _day(1), 2), (None, _day(0), _day(0), 1), (None, _day(2), _day(2), 1),
        ("a", _day(20), _day(20), 1), ("b", _day(3), _day(3), 1),
    ]
    whole = gaps.date_gaps(rows, by=()).collect()
    assert [(r.gap_start, r.missing_days) for r in whole] == [(_day(7), 13)]
    cover = {r.store_id: (r.days_present, r.days_missing, r.longest_gap) for r in gaps.date_coverage(rows).collect()}
    assert cover == {"a": (6, 15, 13), "b": (1, 0, 0), None: (2, 1, 1)}
    assert gaps.date_gaps(facts()).collect() == [] == gaps.date_islands(facts()).collect()


def test_hot_group_is_reduced_before_the_shuffle(inventory):
    plan = _plan(gaps.date_gaps(inventory.fact))
    assert plan.count("HashAggregate") == 2 and plan.rindex("HashAggregate") > plan.rindex("Exchange")
