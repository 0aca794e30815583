"""Reorder recommendations from the given forecast and from recent sales."""

import math
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockyard import params as P
from stockyard import schema as S
from stockyard.functions import classify as C
from stockyard.functions import measures as M
from stockyard.operators.snapshot import latest_snapshot, previous_date, reference_date, trailing_window

REORDER_COLUMNS = [
    "store_id", "product_id", "category", "region", "inventory_level", "demand_forecast",
    "risk_status", "reorder_trigger", "recommended_order_qty",
]


def with_reorder(df: DataFrame, buffer=P.BUFFER, gated=True, rounding="half_up"):
    """Row-local: risk status, trigger and quantity. Works on batches and streams."""
    return df.withColumns(
        {
            "risk_status": C.risk_tier(),
            "reorder_trigger": C.reorder_trigger(),
            "recommended_order_qty": C.order_quantity(buffer, gated, rounding),
        }
    )


def reorder(df: DataFrame, as_of=None, buffer=P.BUFFER, gated=True, rounding="half_up"):
    """Recommendation for the latest (or given) date, largest order first."""
    return (
        with_reorder(latest_snapshot(df, as_of), buffer, gated, rounding)
        .select(*REORDER_COLUMNS)
        .orderBy(F.desc("recommended_order_qty"), "store_id", "product_id")
    )


def reorder_actions(df: DataFrame, as_of=None, buffer=P.BUFFER):
    """Triggered rows only."""
    return reorder(df, as_of, buffer).filter("reorder_trigger").drop("reorder_trigger")


def reorder_totals(df: DataFrame, as_of=None, buffer=P.BUFFER):
    return reorder_actions(df, as_of, buffer).agg(
        M.rows().alias("combinations"),
        F.coalesce(F.sum("recommended_order_qty"), F.lit(0)).alias("total_order_units"),
    )


def reorder_stats(df: DataFrame, as_of=None, gated=False, rounding="half_even"):
    """Snapshot counts: rows per tier, triggered rows, rows with an order, units."""
    table = with_reorder(latest_snapshot(df, as_of), gated=gated, rounding=rounding)
    in_tier = [
        F.count_if(F.col("risk_status") == tier).alias(tier.lower().replace(" ", "_"))
        for tier in P.RISK_TIERS
    ]
    return table.agg(
        M.rows().alias("combinations"),
        *in_tier,
        F.count_if("reorder_trigger").alias("triggered"),
        F.count_if(F.col("recommended_order_qty") > 0).alias("with_order"),
        F.coalesce(F.sum("recommended_order_qty"), F.lit(0)).alias("total_order_units"),
    )


def daily_reorder(df: DataFrame, dates=None, buffer=P.BUFFER):
    """The recurring check: triggered rows of every date, or of the given dates."""
    if dates is not None:
        df = df.filter(F.col("date").isin(list(dates)))
    return (
        with_reorder(df.filter(C.reorder_trigger()), buffer)
        .select("date", *REORDER_COLUMNS)
        .drop("reorder_trigger")
    )


def recent_sales_stats(df: DataFrame, days=P.TRAILING_DAYS, as_of=None):
    """Mean and population deviation of sales per store and product, trailing window."""
    return (
        trailing_window(df, days, as_of)
        .groupBy("store_id", "product_id")
        .agg(
            M.mean(C.SOLD).alias("avg_daily_sales"),
            M.spread(C.SOLD).alias("stddev_daily_sales"),
            M.rows().alias("days_observed"),
        )
    )


def latest_with_stats(df: DataFrame, days=P.TRAILING_DAYS, as_of=None):
    """Latest stock joined with the trailing statistics on store and product."""
    latest = latest_snapshot(df, as_of).select(
        "store_id", "product_id", "inventory_level", "demand_forecast"
    )
    return latest.join(recent_sales_stats(df, days, as_of), ["store_id", "product_id"])


def safety_stock(deviation="stddev_daily_sales", z=P.SERVICE_Z, lead_time=P.LEAD_TIME_DAYS):
    return F.lit(z) * F.coalesce(F.col(deviation), F.lit(0.0)) * F.lit(math.sqrt(lead_time))


def lead_time_demand(rate="avg_daily_sales", lead_time=P.LEAD_TIME_DAYS):
    return F.col(rate) * F.lit(float(lead_time))


def with_latest_stock(df: DataFrame, days=P.TRAILING_DAYS, as_of=None):
    """As ``latest_with_stats`` in one scan and one shuffle.

    The latest row lies inside the trailing window, so the same aggregation that takes
    the statistics can pick it up, as one struct: values of one row stay together even
    if a business key were repeated.
    """
    day = reference_date(df, as_of)
    newest = F.col("date") == day
    return (
        trailing_window(df, days, as_of)
        .groupBy("store_id", "product_id")
        .agg(
            F.max(F.when(newest, F.struct(C.LEVEL, C.FORECAST))).alias("_newest"),
            M.mean(C.SOLD).alias("avg_daily_sales"),
            M.spread(C.SOLD).alias("stddev_daily_sales"),
            M.rows().alias("days_observed"),
        )
        .filter(F.col("_newest").isNotNull())
        .select(
            "store_id", "product_id", f"_newest.{C.LEVEL}", f"_newest.{C.FORECAST}", "avg_daily_sales",
            "stddev_daily_sales", "days_observed",
        )
    )


def trend_reorder_point(
    df: DataFrame, as_of=None, days=P.TRAILING_DAYS, lead_time=P.LEAD_TIME_DAYS, z=P.SERVICE_Z
):
    """Reorder point from recent sales: lead-time demand plus safety stock.

    Most urgent first. ``days_observed`` shows how many rows the estimate rests on.
    """
    return (
        with_latest_stock(df, days, as_of)
        .withColumn("lead_time_demand", lead_time_demand(lead_time=lead_time))
        .withColumn("safety_stock", safety_stock(z=z, lead_time=lead_time))
        .withColumn(
            "reorder_point_trend_based", F.col("lead_time_demand") + F.col("safety_stock")
        )
        .withColumn("stock_status", C.trend_status("reorder_point_trend_based"))
        .select(
            "store_id",
            "product_id",
            F.col(C.LEVEL).alias("current_stock"),
            F.col("avg_daily_sales").alias("avg_daily_sales_90d"),
            F.col("stddev_daily_sales").alias("stddev_daily_sales_90d"),
            "days_observed",
            "lead_time_demand",
            "safety_stock",
            "reorder_point_trend_based",
            F.col(C.FORECAST).alias("given_demand_forecast"),
            "stock_status",
        )
        .orderBy(C.rank_in("stock_status", P.TREND_STATUSES), "store_id", "product_id")
    )


def reorder_point_history(
    df: DataFrame, days=P.TRAILING_DAYS, lead_time=P.LEAD_TIME_DAYS, z=P.SERVICE_Z, chunk=360
):
    """The reorder point of every day: for each row, what ``trend_reorder_point`` would say
    of its store and product with the row's date as reference.

    A pair's days are cut into chunks of ``chunk`` days, and the ``days - 1`` days before a
    chunk are copied to it, so a pair with a long history is spread over tasks; of 90 days
    on 360 that copies a quarter of the rows. A trailing total is the difference of two
    running totals, each of which takes a row once, however long the window; totals are
    whole numbers, so nothing is lost in the difference. One scan, one shuffle.
    """
    day = F.unix_date("date")
    own = F.floor(day / chunk)
    # the chunks of the dates whose window holds this row
    reach = F.sequence(own, F.floor((day + days - 1) / chunk))
    rows = df.select(
        "store_id", "product_id", "date", C.LEVEL, C.FORECAST, day.alias("_day"), own.alias("_own"),
        F.explode(reach).alias("_chunk"), F.col(C.SOLD).cast("bigint").alias("_sold"),
    )
    pair = W.partitionBy("store_id", "product_id", "_chunk").orderBy("_day")
    upto, before = pair.rangeBetween(W.unboundedPreceding, 0), pair.rangeBetween(W.unboundedPreceding, -days)

    def trailing(total):
        return total.over(upto) - F.coalesce(total.over(before), F.lit(0))

    sold = F.col("_sold")
    rows = rows.select(
        "*", trailing(M.rows()).alias("days_observed"), trailing(F.count(sold)).alias("_n"),
        trailing(F.sum(sold)).alias("_total"), trailing(F.sum(sold * sold)).alias("_squares"),
    ).filter(F.col("_chunk") == F.col("_own"))
    n, total, squares = (F.col(c).cast("decimal(19,0)") for c in ("_n", "_total", "_squares"))
    count = F.col("_n").cast("double")
    return (
        rows.withColumn("avg_daily_sales", F.try_divide(F.col("_total").cast("double"), count))
        .withColumn(
            "stddev_daily_sales",
            F.sqrt(F.try_divide((n * squares - total * total).cast("double"), count * count)),
        )
        .withColumn("lead_time_demand", lead_time_demand(lead_time=lead_time))
        .withColumn("safety_stock", safety_stock(z=z, lead_time=lead_time))
        .withColumn("reorder_point_trend_based", F.col("lead_time_demand") + F.col("safety_stock"))
        .withColumn("stock_status", C.trend_status("reorder_point_trend_based"))
        .select(
            "date", "store_id", "product_id", F.col(C.LEVEL).alias("current_stock"),
            F.col("avg_daily_sales").alias("avg_daily_sales_90d"),
            F.col("stddev_daily_sales").alias("stddev_daily_sales_90d"), "days_observed", "lead_time_demand",
            "safety_stock", "reorder_point_trend_based", F.col(C.FORECAST).alias("given_demand_forecast"),
            "stock_status",
        )
    )


# Fixed order: what became of an order from one date to the next.
CHANGES = ["New", "Changed", "Unchanged", "Withdrawn"]


def reorder_changes(df: DataFrame, as_of=None, since=None, buffer=P.BUFFER, all_rows=False):
    """What changed in the order list between two dates: new, changed, withdrawn orders.

    ``as_of`` is the later date (by default the latest of the fact), ``since`` the earlier
    (by default the last date before it that the fact holds). The two order lists, each
    from one pruned period, meet in a full outer join that is null-safe in both keys. A date
    without rows counts as an empty list. ``all_rows`` shows unchanged orders too.
    """
    later = latest_snapshot(df, as_of)
    earlier = df.filter(F.col("date") == previous_date(df, as_of)) if since is None else latest_snapshot(df, since)
    if since is None:
        for column, unit in S.GRAINS.items():
            if column in df.columns:
                earlier = earlier.filter(F.col(column) == previous_date(df, as_of, lambda d, u=unit: F.trunc(d, u)))
    keys, values = ["store_id", "product_id"], ["category", "region", C.LEVEL, C.FORECAST, "recommended_order_qty"]

    def orders(rows, suffix):
        listed = with_reorder(rows, buffer).filter("reorder_trigger")
        return listed.select(*[F.col(c).alias(f"{c}{suffix}") for c in [*keys, *values]])

    now, then = orders(later, "_now"), orders(earlier, "_then")
    same = [F.col(f"{c}_now").eqNullSafe(F.col(f"{c}_then")) for c in keys]
    joined = now.join(then, reduce(and_, same), "full")
    quantity = [F.col(f"recommended_order_qty{s}") for s in ("_now", "_then")]
    change = (
        F.when(quantity[1].isNull(), CHANGES[0]).when(quantity[0].isNull(), CHANGES[3])
        .when(quantity[0] != quantity[1], CHANGES[1]).otherwise(CHANGES[2])
    )
    listed = quantity[0].isNotNull()
    latest = lambda c: F.when(listed, F.col(f"{c}_now")).otherwise(F.col(f"{c}_then")).alias(c)
    result = joined.select(
        *[latest(c) for c in [*keys, "category", "region"]], change.alias("change"),
        F.col(f"{C.LEVEL}_then").alias("inventory_before"), F.col(f"{C.LEVEL}_now").alias("inventory_now"),
        quantity[1].alias("order_qty_before"), quantity[0].alias("order_qty_now"),
        (F.coalesce(quantity[0], F.lit(0)) - F.coalesce(quantity[1], F.lit(0))).alias("order_qty_change"),
    )
    if not all_rows:
        result = result.filter(F.col("change") != CHANGES[2])
    return result.orderBy(C.rank_in("change", CHANGES), F.desc(F.abs("order_qty_change")), *keys)


def reorder_change_totals(df: DataFrame, as_of=None, since=None, buffer=P.BUFFER):
    """Orders and units per kind of change."""
    return (
        reorder_changes(df, as_of, since, buffer, all_rows=True).groupBy("change")
        .agg(M.rows().alias("combinations"), F.sum("order_qty_change").alias("units_change"))
        .orderBy(C.rank_in("change", CHANGES))
    )


def publish_daily_reorder(df: DataFrame, path, as_of):
    """Write one day's triggered rows as the partition of that day.

    A rerun replaces exactly that partition, also when nothing is triggered any more.
    """
    orders = daily_reorder(latest_snapshot(df, as_of)).drop("date")
    orders.write.mode("overwrite").parquet(f"{path}/date={as_of}")
    return path
