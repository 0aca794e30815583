"""Boundaries of the row rules and the aggregate definitions."""

import math
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stockyard import params as P
from stockyard.functions import classify as C
from stockyard.functions import measures as M
from stockyard.operators import cleaning, kpi

EDGES = [
    # stock, forecast, tier, narrow tier, shelf status
    (100, 100, "Balanced", "Balanced", "Adequate Stock"),
    (150, 100, "Balanced", "High Inventory", "Adequate Stock"),
    (151, 100, "High Inventory", "Excess Inventory", "Adequate Stock"),
    (200, 100, "High Inventory", "Excess Inventory", "Adequate Stock"),
    (201, 100, "Excess Inventory", "Excess Inventory", "Adequate Stock"),
    (99, 100, "Understocked", "Balanced", "Near Reorder"),
    (75, 100, "Understocked", "Balanced", "Near Reorder"),
    (74, 100, "Understocked", "Understocked", "Below Reorder"),
    (60, 0, "Excess Inventory", "Excess Inventory", "Adequate Stock"),
    (0, 10, "Understocked", "Understocked", "Out of Stock"),
    (0, 0, "Balanced", "Balanced", "Out of Stock"),
    (60, None, "Excess Inventory", "Excess Inventory", "Adequate Stock"),
]


def test_tiers_and_status(facts):
    rows = facts(*[{"inventory_level": e[0], "demand_forecast": e[1], "units_sold": i} for i, e in enumerate(EDGES)])
    found = rows.select(
        "units_sold", C.risk_tier().alias("a"), C.risk_tier(P.NARROW_CUTS).alias("b"), C.shelf_status().alias("c")
    ).orderBy("units_sold").collect()
    assert [(r.a, r.b, r.c) for r in found] == [e[2:] for e in EDGES]


# Rows of the published reorder table: stock, forecast, tier, trigger, ungated, gated.
GOLDEN = [
    (497, "489.62", "Balanced", False, 42, 0),
    (413, "409.17", "Balanced", False, 37, 0),
    (181, "192.84", "Understocked", True, 31, 31),
    (342, "335.72", "Balanced", False, 27, 0),
    (149, "154.83", "Understocked", True, 21, 21),
    (98, "105.61", "Understocked", True, 18, 18),
    (108, "108.96", "Understocked", True, 12, 12),
    (85, "63.69", "Balanced", False, 0, 0),
    (113, "10.72", "Excess Inventory", False, 0, 0),
]


def test_published_reorder_rows(facts):
    rows = facts(*[{"inventory_level": g[0], "demand_forecast": g[1], "units_sold": i} for i, g in enumerate(GOLDEN)])
    found = rows.select(
        "units_sold",
        C.risk_tier().alias("tier"),
        C.reorder_trigger().alias("trigger"),
        C.order_quantity(gated=False, rounding="half_even").alias("ungated"),
        C.order_quantity().alias("gated"),
    ).orderBy("units_sold").collect()
    assert [tuple(r)[1:] for r in found] == [g[2:] for g in GOLDEN]


def test_rounding_of_half_units(facts):
    # 15.00 * 1.10 - 10 = 6.5
    row = facts({"inventory_level": 10, "demand_forecast": 15})
    assert row.select(C.order_quantity()).first()[0] == 7
    assert row.select(C.order_quantity(rounding="half_even")).first()[0] == 6


def test_clip_keeps_missing_forecasts(facts):
    rows = facts({"demand_forecast": -9.99}, {"demand_forecast": None}, {"demand_forecast": 3})
    clipped = [r.demand_forecast for r in cleaning.clip_negative_forecast(rows).collect()]
    assert [None if v is None else float(v) for v in clipped] == [0.0, None, 3.0]
    assert cleaning.clip_report(rows).first().asDict() == {
        "negative_before": 1, "negative_after": 0, "rows_before": 3, "rows_after": 3,
    }


def test_clean_is_idempotent_and_deterministic(facts):
    rows = facts(
        {"inventory_level": 90, "demand_forecast": -1},
        {"inventory_level": 80},
        {"store_id": "S002"},
        {"store_id": "S002"},
    )
    once = cleaning.clean(rows)
    assert sorted(once.collect()) == sorted(cleaning.clean(once).collect())
    assert once.count() == 2
    assert once.filter("store_id = 'S001'").first().inventory_level == 80


def test_lenient_and_strict_dates(spark):
    text = spark.createDataFrame([("2023-01-31",), ("2023-02-31",), ("x",), (None,)], "date string")
    assert cleaning.invalid_date_count(text).first().asDict() == {"total_rows": 4, "invalid_dates": 3}
    assert cleaning.parse_dates(text, strict=False).filter("date is null").count() == 3
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        with pytest.raises(Exception, match="not a date"):
            cleaning.parse_dates(text).collect()
    spark.conf.unset("spark.sql.ansi.enabled")
    good = text.filter("date = '2023-01-31' or date is null")
    assert sorted(str(r.date) for r in cleaning.parse_dates(good).collect()) == ["2023-01-31", "None"]


def test_time_features(facts):
    row = cleaning.with_time_features(facts({"date": "2023-01-01"})).first()
    assert (row.year, row.month, row.month_name, row.day_of_week, row.week) == (2023, 1, "January", "Sunday", 52)


def test_error_columns(facts):
    rows = cleaning.with_forecast_error(
        facts({"units_sold": 30, "demand_forecast": 40}, {"units_sold": 5, "demand_forecast": 0})
    ).collect()
    assert [float(r.forecast_error) for r in rows] == [-10, 5]
    assert [float(r.absolute_forecast_error) for r in rows] == [10, 5]
    assert [r.forecast_error_pct for r in rows] == [25.0, None]


def test_accuracy_variants(facts):
    rows = facts(
        {"units_sold": 10, "demand_forecast": 13},
        {"units_sold": 20, "demand_forecast": 16},
        {"units_sold": 0, "demand_forecast": 5},
        {"units_sold": 7, "demand_forecast": None},
    )
    selling = kpi.forecast_accuracy(rows).first()
    assert (selling.mae, selling.rmse, selling.mape) == (3.5, math.sqrt(12.5), 25.0)
    every = kpi.forecast_accuracy(rows, selling_rows_only=False).first()
    assert every.mae == 4.0
    assert every.rmse == math.sqrt(50 / 3)
    assert every.mape == 25.0


def test_accuracy_of_nothing_is_null(facts):
    empty = facts({"units_sold": 0})
    assert tuple(kpi.forecast_accuracy(empty).first()) == (None, None, None)


def test_ratios_without_divisor(facts):
    rows = facts({"units_sold": 0, "inventory_level": 0, "units_ordered": 0})
    assert kpi.inventory_to_sales(rows).first()[0] is None
    assert kpi.turnover_proxy(rows).first()[0] is None
    assert kpi.monthly_sell_through(rows).first().sell_through_rate is None
    row = kpi.order_efficiency(rows).first()
    assert row.order_to_sales_ratio is None and row.sales_to_order_pct is None


def test_risk_percentages_sum_to_100(inventory):
    for valid_only in (True, False):
        shares = [r.percentage for r in kpi.risk_distribution(inventory.fact, valid_only).collect()]
        assert abs(sum(shares) - 100) < 1e-9
    for row in kpi.risk_by(inventory.fact, ["store_id"]).collect():
        assert abs(sum(row[2:]) - 100) < 1e-9


def test_hundredths_are_exact(facts):
    values = ["0.01", "0.07", "0.29", "1.13", "518.55", "-9.99", "99999999.99", "8.41"]
    rows = facts(*[{"demand_forecast": v} for v in values])
    found = [r[0] for r in rows.select(M.hundredths("demand_forecast")).collect()]
    assert found == [1, 7, 29, 113, 51855, -999, 9999999999, 841]


def test_spread_is_population_by_default(facts):
    rows = facts(*[{"units_sold": v} for v in (2, 4, 4, 4, 5, 5, 7, 9)])
    assert rows.agg(M.spread("units_sold")).first()[0] == 2.0
    assert abs(rows.agg(M.spread("units_sold", sample=True)).first()[0] - math.sqrt(32 / 7)) < 1e-12
    one = facts({"units_sold": 9})
    assert one.agg(M.spread("units_sold")).first()[0] == 0.0
    assert one.agg(M.spread("units_sold", sample=True)).first()[0] is None


def test_kpi_summary_order(facts):
    summary = kpi.kpi_summary(facts({"inventory_level": 160, "demand_forecast": 100, "units_sold": 80})).collect()
    assert [r.metric for r in summary][:2] == ["Total Observations", "Total Units Sold"]
    values = {r.metric: r.value for r in summary}
    assert values["Overstock %"] == 100.0 and values["Balanced Inventory %"] == 0.0
    assert values["Forecast MAPE"] == 25.0


def test_share_column_values(facts):
    rows = facts({"region": "a"}, {"region": "a"}, {"region": "b"}, {"region": "b"})
    counts = rows.groupBy("region").agg(F.count("*").alias("observations"))
    from stockyard.operators.quality import share_of_total

    assert {r.region: r.percentage for r in share_of_total(counts).collect()} == {"a": 50.0, "b": 50.0}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 600), st.integers(0, 60_000), st.integers(0, 500)), min_size=1, max_size=30))
def test_rules_against_plain_python(facts, rows):
    frame = facts(
        *[
            {"inventory_level": level, "demand_forecast": Decimal(cents) / 100, "units_sold": sold}
            for level, cents, sold in rows
        ]
    )

    def tier(level, cents):
        cuts = [(level * 100 < cents), (level * 200 <= cents * 3), (level * 100 <= cents * 2)]
        return P.RISK_TIERS[cuts.index(True) if True in cuts else 3]

    def order(level, cents):
        gap = Decimal(cents) / 100 * Decimal("1.10") - level
        return int(gap.quantize(0, ROUND_HALF_UP)) if level * 100 < cents else 0

    found = frame.select(
        "inventory_level", "demand_forecast", C.risk_tier().alias("t"), C.order_quantity().alias("q")
    ).collect()
    for row, (level, cents, _) in zip(found, rows):
        assert (row.t, row.q) == (tier(level, cents), order(level, cents))
    errors = [sold * 100 - cents for _, cents, sold in rows if sold > 0]
    scored = kpi.forecast_accuracy(frame).first()
    if errors:
        assert scored.mae == sum(map(abs, errors)) / 100 / len(errors)
        assert math.isclose(scored.rmse, math.sqrt(sum(e * e for e in errors) / 10_000 / len(errors)))
