"""KPIs, risk shares, forecast accuracy and demand drivers.

Every report is ``filter -> groupBy(by) -> named measures``. All measures are
algebraic, so each task reduces its rows to one per group before the shuffle and a
group that holds a third of the rows costs no more than any other.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard import params as P
from stockyard.functions import classify as C
from stockyard.functions import measures as M
from stockyard.operators.quality import share_of_total, to_long
from stockyard.operators.reshape import reindex


def report(df: DataFrame, by=(), measures=(), where=None, order=()):
    """Grouped report. ``order`` holds columns or (column, "desc"); keys break ties."""
    if where is not None:
        df = df.filter(where)
    result = M.summarize(df, list(by), measures)
    if not by:
        return result
    keys = [F.desc(o[0]) if isinstance(o, tuple) else F.asc(o) for o in order]
    return result.orderBy(*keys, *by)


# --- KPIs -------------------------------------------------------------------

PERFORMANCE = [
    "total_units_sold", "total_units_ordered", "avg_inventory", "avg_demand_forecast",
    "inventory_turnover_proxy",
]
SEGMENT_RISK = [
    "valid_observations", "understocked_pct", "balanced_pct", "high_inventory_pct",
    "excess_inventory_pct",
]
ACCURACY = ["observations", "mae", "rmse", "mape"]


def network_kpis(df):
    return report(
        df,
        measures=["total_units_sold", "total_units_ordered", "avg_inventory_level", "avg_demand_forecast"],
    )


def inventory_to_sales(df, by=()):
    return report(df, by, ["inventory_to_sales_ratio"])


def turnover_proxy(df, by=()):
    return report(df, by, ["inventory_turnover_proxy"])


def performance(df, by):
    return report(df, by, PERFORMANCE, order=[("total_units_sold", "desc")])


def order_efficiency(df, by=("store_id",)):
    return report(
        df,
        by,
        ["total_units_sold", "total_units_ordered", "order_to_sales_ratio", "sales_to_order_pct"],
        order=[("order_to_sales_ratio", "desc")],
    )


def inventory_coverage(df, by=()):
    return report(df, by, ["avg_inventory_coverage"], where=F.col(C.FORECAST) > 0)


def overview_kpis(df):
    return with_risk(df).agg(
        M.mean(C.LEVEL).alias("avg_inventory"),
        F.sum(C.SOLD).alias("total_units_sold"),
        F.sum(C.ORDERED).alias("total_units_ordered"),
        M.tier_percent(0).alias("low_inventory_risk_rate"),
        M.tier_percent(3).alias("overstock_risk_rate"),
    )


def store_region_summary(df, by):
    return report(df, by, ["units_sold", "avg_inventory", "low_inventory_risk_rate"])


def kpi_summary(df):
    """Ten (metric, value) rows with their order, from one aggregation."""
    # The metric names.
    wide = df.agg(
        M.rows().cast("double").alias("Total Observations"),
        F.sum(C.SOLD).cast("double").alias("Total Units Sold"),
        F.sum(C.ORDERED).cast("double").alias("Total Units Ordered"),
        M.mean(C.LEVEL).alias("Average Inventory"),
        M.mean(C.FORECAST).alias("Average Demand Forecast"),
        M.mean_absolute_error().alias("Forecast MAE"),
        M.root_mean_square_error().alias("Forecast RMSE"),
        M.mean_absolute_percentage_error().alias("Forecast MAPE"),
        M.percent(C.overstocked()).alias("Overstock %"),
        M.percent(C.in_balanced_band()).alias("Balanced Inventory %"),
    )
    order = wide.columns
    return (
        to_long(wide, None, "metric", "value")
        .withColumn("position", C.rank_in("metric", order))
        .orderBy("position")
    )


# --- every slice in one pass ------------------------------------------------

SLICES = [("store_id",), ("category",), ("product_id",), ("region",)]


def _part_sums():
    """Exact sums that every measure of a slice follows from; they add up over groups.
    A count of risk tiers takes rows with a positive forecast."""
    valid = F.col(C.FORECAST) > 0
    tiers = {f"_tier{i}": F.count_if(valid & (F.col(C.RISK) == tier)) for i, tier in enumerate(P.RISK_TIERS)}
    return {
        "_rows": M.rows(), "_sold": F.sum(C.SOLD), "_sold_rows": F.count(C.SOLD), "_ordered": F.sum(C.ORDERED),
        "_level": F.sum(C.LEVEL), "_level_rows": F.count(C.LEVEL), "_forecast": F.sum(M.hundredths(C.FORECAST)),
        "_forecast_rows": F.count(C.FORECAST), "_valid": F.count_if(valid), **tiers,
    }


def cube(df: DataFrame, slices=SLICES):
    """Performance and risk shares of every slice, from one scan of the fact.

    ``slices`` are lists of columns; () is the whole network. The rows are first reduced to
    exact sums of the finest groups that occur, before the shuffle; GROUPING SETS then add
    these sums up, not the rows. ``slice`` names the columns, which are null where a slice does
    not have them. The values are those of ``performance`` and ``risk_by`` to the last bit; a
    group without a positive forecast, which ``risk_by`` leaves out, has no shares.
    """
    slices = [tuple(s) for s in slices]
    keys = list(dict.fromkeys(c for s in slices for c in s))
    sums = _part_sums()
    finest = with_risk(df).groupBy(*keys).agg(*[total.alias(name) for name, total in sums.items()])
    sets = finest.groupingSets([list(s) for s in slices], *keys).agg(
        F.grouping_id().alias("_set"), *[F.sum(name).alias(name) for name in sums]
    )
    # the id has a 0 where a slice has the column
    number = {s: sum(2 ** (len(keys) - 1 - i) for i, c in enumerate(keys) if c not in s) for s in slices}
    names = F.create_map(*[F.lit(x) for s in slices for x in (number[s], " x ".join(s) or "network")])

    def mean(total, rows, unit=1):
        whole = F.col(total).cast("double")
        return F.try_divide(whole if unit == 1 else whole / unit, F.col(rows))

    stock = mean("_level", "_level_rows")
    shares = [name for name in SEGMENT_RISK if name != "valid_observations"]
    return sets.select(
        names[F.col("_set").cast("int")].alias("slice"), *keys,
        F.col("_sold").alias("total_units_sold"), F.col("_ordered").alias("total_units_ordered"),
        stock.alias("avg_inventory"), mean("_forecast", "_forecast_rows", 100).alias("avg_demand_forecast"),
        F.try_divide(mean("_sold", "_sold_rows"), stock).alias("inventory_turnover_proxy"),
        F.col("_valid").alias("valid_observations"),
        *[F.try_divide(F.lit(100.0) * F.col(f"_tier{i}"), F.col("_valid")).alias(c) for i, c in enumerate(shares)],
    ).orderBy("slice", F.desc("total_units_sold"), *keys)


# --- risk -------------------------------------------------------------------


def with_risk(df: DataFrame, cuts=P.CANONICAL_CUTS, into=C.RISK):
    return df.withColumn(into, C.risk_tier(cuts))


def risk_distribution(df: DataFrame, valid_only=True, cuts=P.CANONICAL_CUTS, all_tiers=False):
    """Rows and percent per tier, in tier order.

    ``valid_only`` leaves rows without a positive forecast out of both numbers;
    ``all_tiers`` shows tiers without rows too, with 0.
    """
    if valid_only:
        df = df.filter(F.col(C.FORECAST) > 0)
    counts = with_risk(df, cuts).groupBy("inventory_risk").agg(M.rows().alias("observations"))
    if all_tiers:
        counts = reindex(counts, "inventory_risk", P.RISK_TIERS, fill=0)
    counts = counts.withColumn("risk_rank", C.rank_in("inventory_risk", P.RISK_TIERS))
    return share_of_total(counts).select(
        "inventory_risk", "observations", "risk_rank", "percentage"
    ).orderBy("risk_rank")


def risk_by(df: DataFrame, by, extra=()):
    head, *tail = SEGMENT_RISK
    return report(
        with_risk(df), by, [head, *extra, *tail],
        where=F.col(C.FORECAST) > 0, order=[("understocked_pct", "desc")],
    )


def risk_composition(df: DataFrame, by=("store_id",)):
    return (
        with_risk(df)
        .groupBy(*by, "inventory_risk")
        .agg(M.rows().alias("observations"))
        .orderBy(*by, C.rank_in("inventory_risk", P.RISK_TIERS))
    )


def overstock(df: DataFrame, by, factor=P.OVERSTOCK_FACTOR):
    """Rows above ``factor`` times a positive forecast, per group."""
    flagged = C.overstocked(factor)
    return (
        df.filter(F.col(C.FORECAST) > 0)
        .groupBy(*by)
        .agg(
            M.rows().alias("observations"),
            F.count_if(flagged).alias("overstock_observations"),
            M.mean(C.LEVEL).alias("avg_inventory"),
            M.mean(C.FORECAST).alias("avg_demand_forecast"),
            F.sum(C.SOLD).alias("total_units_sold"),
            M.percent(flagged).alias("overstock_pct"),
        )
        .orderBy(F.desc("overstock_pct"), *by)
    )


def excess_by(df: DataFrame, by):
    """Rows in the last tier over all rows, per group."""
    excess = C.risk_tier() == P.RISK_TIERS[3]
    return (
        df.groupBy(*by)
        .agg(
            M.rows().alias("observations"),
            F.count_if(excess).alias("overstock_observations"),
            M.percent(excess).alias("overstock_pct"),
        )
        .orderBy(F.desc("overstock_pct"), *by)
    )


def understocked_segments(df: DataFrame, by=("store_id", "category")):
    return (
        df.filter((F.col(C.FORECAST) >= 0) & C.reorder_trigger())
        .groupBy(*by)
        .agg(
            M.rows().alias("understocked_observations"),
            *[M.measure(m) for m in ("avg_inventory", "avg_demand_forecast", "avg_units_sold", "avg_inventory_gap")],
        )
        .orderBy(F.desc("understocked_observations"), *by)
    )


def excess_segments(df: DataFrame, by=("store_id", "category")):
    above = F.col(C.LEVEL) > F.col(C.FORECAST) * F.lit(P.CANONICAL_CUTS[2])
    return (
        df.filter((F.col(C.FORECAST) >= 0) & above)
        .groupBy(*by)
        .agg(
            M.rows().alias("excess_inventory_observations"),
            *[M.measure(m) for m in ("avg_inventory", "avg_demand_forecast", "avg_inventory_surplus")],
        )
        .orderBy(F.desc("excess_inventory_observations"), *by)
    )


# --- efficiency -------------------------------------------------------------


def store_efficiency(df: DataFrame):
    """Units sold over mean stock times mean rows per store."""
    per_store = M.summarize(
        df, ["store_id"], ["total_units_sold", "avg_inventory", "avg_demand_forecast", "observations"]
    )
    rows_per_store = per_store.agg(
        F.sum("observations").cast("double") / F.count(F.lit(1))
    ).scalar()
    stock_days = F.col("avg_inventory") * rows_per_store
    return (
        per_store.withColumn(
            "inventory_efficiency", F.try_divide(F.col("total_units_sold").cast("double"), stock_days)
        )
        .drop("observations")
        .orderBy(F.desc("inventory_efficiency"), "store_id")
    )


def store_efficiency_daily(df: DataFrame):
    """Units sold over mean stock times the number of distinct dates."""
    days = df.agg(F.count_distinct("date")).scalar()
    stock_days = F.col("avg_inventory") * days
    return (
        M.summarize(df, ["store_id"], ["total_units_sold", "avg_inventory", "avg_demand_forecast"])
        .withColumn(
            "inventory_efficiency", F.try_divide(F.col("total_units_sold").cast("double"), stock_days)
        )
        .orderBy("store_id")
    )


# --- forecast accuracy ------------------------------------------------------


def forecast_accuracy(df: DataFrame, by=(), selling_rows_only=True, worst_first=True):
    """MAE, RMSE and MAPE.

    ``selling_rows_only``: all three over rows with a valid forecast and sales.
    Otherwise MAE and RMSE use every row with a forecast; only MAPE skips rows
    without sales.
    """
    if selling_rows_only:
        where = (F.col(C.FORECAST) >= 0) & (F.col(C.SOLD) > 0)
    else:
        where = F.col(C.FORECAST).isNotNull()
    measures = ACCURACY if by else ACCURACY[1:]
    return report(df, by, measures, where, [("mae", "desc")] if worst_first else ["mae"])


def accuracy_by_risk(df: DataFrame, cuts=P.CANONICAL_CUTS, selling_rows_only=True):
    scored = forecast_accuracy(with_risk(df, cuts), ["inventory_risk"], selling_rows_only)
    return scored.orderBy(C.rank_in("inventory_risk", P.RISK_TIERS))


# --- drivers ----------------------------------------------------------------

DRIVER_MEASURES = {
    "discount": ["avg_units_sold", "avg_demand_forecast", "avg_inventory", "avg_price"],
    "holiday_promotion": ["avg_units_sold", "avg_demand_forecast", "avg_inventory", "avg_units_ordered"],
    "seasonality": ["avg_units_sold", "avg_demand_forecast", "avg_inventory", "avg_units_ordered"],
    "weather_condition": ["avg_units_sold", "avg_demand_forecast", "avg_inventory", "avg_units_ordered"],
}


def drivers(df: DataFrame, driver, measures=None, best_first=None, valid_only=True):
    """Average outcomes per value of a demand driver, on rows with a valid forecast or
    (``valid_only`` off) on all."""
    if best_first is None:
        best_first = driver in ("seasonality", "weather_condition")
    return report(
        df, [driver], ["observations", *(measures or DRIVER_MEASURES[driver])],
        where=F.col(C.FORECAST) >= 0 if valid_only else None,
        order=[("avg_units_sold", "desc")] if best_first else [],
    )


# --- monthly ----------------------------------------------------------------


def with_month(df: DataFrame):
    return df.withColumn("month", F.trunc("date", "MM"))


def monthly(df: DataFrame, by=(), measures=("units_sold", "units_ordered")):
    return M.summarize(with_month(df), ["month", *by], measures).orderBy("month", *by)


def monthly_sell_through(df: DataFrame, by=("region",)):
    return monthly(df, by, ["units_sold", "units_ordered", "sell_through_rate"])


def monthly_region_inventory(df: DataFrame, by=("region",)):
    return monthly(df, by, ["units_sold", "avg_inventory"])
