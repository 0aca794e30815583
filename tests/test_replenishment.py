import datetime
import math

import pytest

from stockyard.operators import replenishment as R
from stockyard.streaming import reorder_stream


@pytest.fixture(scope="module")
def history(facts):
    rows = []
    for back in range(0, 120):
        day = datetime.date(2024, 1, 1) - datetime.timedelta(days=back)
        rows.append({"date": day, "store_id": "S1", "units_sold": 10 if back % 2 else 20, "inventory_level": 22})
        rows.append({"date": day, "store_id": "S2", "units_sold": 5, "inventory_level": 5})
    rows.append({"date": datetime.date(2024, 1, 1), "store_id": "S3", "units_sold": 0, "inventory_level": 0})
    rows.append({"date": datetime.date(2023, 12, 31), "store_id": "S4", "units_sold": 9})
    return facts(*rows)


def test_trend_reorder_point(history):
    rows = {r.store_id: r for r in R.trend_reorder_point(history).collect()}
    assert set(rows) == {"S1", "S2", "S3"}  # S4 has no row on the latest date
    one = rows["S1"]
    assert one.days_observed == 90 and one.avg_daily_sales_90d == 15.0 and one.stddev_daily_sales_90d == 5.0
    assert one.reorder_point_trend_based == 15.0 + 1.65 * 5.0 and one.stock_status == "Below Reorder Point"
    assert rows["S2"].safety_stock == 0.0 and rows["S2"].stock_status == "Adequate Stock"
    assert rows["S3"].stock_status == "Out of Stock" and rows["S3"].days_observed == 1


def test_trend_order_and_parameters(history):
    rows = R.trend_reorder_point(history).collect()
    assert [r.store_id for r in rows] == ["S3", "S1", "S2"]
    week = {r.store_id: r for r in R.trend_reorder_point(history, lead_time=7).collect()}
    assert week["S1"].lead_time_demand == 105.0
    assert week["S1"].safety_stock == 1.65 * 5.0 * math.sqrt(7)
    past = {r.store_id: r for r in R.trend_reorder_point(history, as_of="2023-12-31", days=10).collect()}
    assert past["S1"].days_observed == 10 and "S4" in past and "S3" not in past


def test_one_pass_equals_join(history):
    names = ["store_id", "product_id", "inventory_level", "demand_forecast", "avg_daily_sales", "stddev_daily_sales", "days_observed"]
    joined = R.latest_with_stats(history).select(*names).collect()
    assert sorted(joined) == sorted(R.with_latest_stock(history).select(*names).collect())


def test_reorder_properties(inventory):
    fact = inventory.fact
    day = fact.filter("inventory_level < demand_forecast").groupBy("date").count().orderBy("count", ascending=False).first().date
    table = R.reorder(fact, as_of=day)
    rows = table.collect()
    assert any(r.reorder_trigger for r in rows)
    assert all(r.reorder_trigger for r in rows if r.recommended_order_qty > 0)
    assert [r.recommended_order_qty for r in rows] == sorted((r.recommended_order_qty for r in rows), reverse=True)
    totals = R.reorder_totals(fact, as_of=day).first()
    assert totals.total_order_units == sum(r.recommended_order_qty for r in rows)
    assert totals.combinations == sum(r.reorder_trigger for r in rows)


def test_snapshot_without_triggers(facts):
    totals = R.reorder_totals(facts({"inventory_level": 500})).first()
    assert tuple(totals) == (0, 0)


def test_publishing_a_day_twice_replaces_it(spark, facts, tmp_path):
    path = str(tmp_path / "orders")
    short = {"inventory_level": 10}
    first = facts({**short, "store_id": "a"}, {**short, "store_id": "b"}, {**short, "date": "2023-04-30"})
    R.publish_daily_reorder(first, path, "2023-04-30")
    R.publish_daily_reorder(first, path, "2023-05-01")
    assert spark.read.parquet(path).count() == 3
    R.publish_daily_reorder(facts({**short, "store_id": "a"}), path, "2023-05-01")
    assert spark.read.parquet(path).count() == 2
    R.publish_daily_reorder(facts({"inventory_level": 900}), path, "2023-05-01")
    assert spark.read.parquet(path).count() == 1


def test_values_of_one_row_stay_together(facts):
    rows = facts({"inventory_level": 5, "demand_forecast": 90}, {"inventory_level": 8, "demand_forecast": 20})
    row = R.with_latest_stock(rows).first()
    assert (row.inventory_level, float(row.demand_forecast)) in [(5, 90.0), (8, 20.0)]


def test_absent_tiers_and_segments_show(facts):
    from stockyard.operators import kpi, movement

    rows = facts({"inventory_level": 10, "demand_forecast": 50})
    tiers = [(r.inventory_risk, r.observations) for r in kpi.risk_distribution(rows, all_tiers=True).collect()]
    assert [n for _, n in tiers] == [1, 0, 0, 0]
    segments = movement.segment_summary(movement.segments(rows)).collect()
    assert [(r.movement_segment, r.num_products) for r in segments] == [
        ("Fast-moving", 0), ("Medium-moving", 0), ("Slow-moving", 1),
    ]


def test_drivers_of_all_rows(facts):
    from stockyard.operators import kpi

    rows = facts({"demand_forecast": None, "discount": 5}, {"discount": 5})
    assert kpi.drivers(rows, "discount").first().observations == 1
    assert kpi.drivers(rows, "discount", valid_only=False).first().observations == 2
