"""Product movement: metrics, slow / medium / fast segments, watchlists."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard import params as P
from stockyard.functions import measures as M
from stockyard.functions import classify as C
from stockyard.operators.ordering import column_quantiles, ntile, top_k
from stockyard.operators.reshape import reindex
from stockyard.session import materialize


def movement_metrics(df: DataFrame, by=("product_id",), daily="dates"):
    """Per-product movement.

    ``daily`` divides units by distinct dates (``dates``) or by rows (``rows``).
    ``active_selling_days`` counts rows with sales, as its name does not say.
    """
    if daily == "rows":
        per_day = M.mean(C.SOLD)
        grouped = df.groupBy(*by).agg(*_metrics(), per_day.alias("avg_daily_units_sold"))
    else:
        # One partial row per (product, date), then per product: a distinct count
        # that never holds one product's dates in a single task.
        per_date = df.groupBy(*by, "date").agg(
            F.sum(C.SOLD).alias("_sold"),
            F.count(C.SOLD).alias("_n_sold"),
            F.sum(C.LEVEL).alias("_level"),
            F.count(C.LEVEL).alias("_n_level"),
            M.rows().alias("_n"),
            F.count_if(F.col(C.SOLD) > 0).alias("_active"),
            F.count_if(C.reorder_trigger()).alias("_low"),
        )
        sold, level = F.sum("_sold"), F.sum("_level")
        stock = F.try_divide(level.cast("double"), F.sum("_n_level"))
        grouped = per_date.groupBy(*by).agg(
            sold.alias("total_units_sold"),
            M.ratio(sold, F.count("date")).alias("avg_daily_units_sold"),
            stock.alias("avg_inventory"),
            F.try_divide(F.try_divide(sold.cast("double"), F.sum("_n_sold")), stock).alias(
                "inventory_turnover_proxy"
            ),
            F.sum("_active").alias("active_selling_days"),
            F.try_divide(F.lit(100.0) * F.sum("_low"), F.sum("_n")).alias("low_inventory_risk_rate"),
        )
    return grouped.orderBy(F.desc("total_units_sold"), *by)


def _metrics():
    names = [
        "total_units_sold", "avg_inventory", "inventory_turnover_proxy", "active_selling_days",
        "low_inventory_risk_rate",
    ]
    return [M.measure(n) for n in names]


SEGMENT_METRICS = [
    "total_units_sold", "avg_inventory", "inventory_turnover_proxy", "low_inventory_risk_rate",
]


def segments(df: DataFrame, by=("product_id",), method="ntile"):
    """Products split in three by turnover.

    ``ntile``: equal group sizes, ties broken by the key. ``quantile``: right-closed
    bins at the interpolated terciles, so equal turnovers share a segment.
    """
    by = list(by)
    metrics = M.summarize(df, by, SEGMENT_METRICS)
    slow, medium, fast = P.SEGMENTS
    if method == "ntile":
        tiled = ntile(metrics, 3, ["inventory_turnover_proxy", *by], into="_tile")
        named = (
            F.when(F.col("_tile") == 1, slow)
            .when(F.col("_tile") == 2, medium)
            .when(F.col("_tile") == 3, fast)
        )
        result = tiled.withColumn("movement_segment", named).drop("_tile")
    else:
        metrics = materialize(metrics, "segment_metrics")  # read for the edges and the rows
        edges = column_quantiles(metrics, ["inventory_turnover_proxy"], [1 / 3, 2 / 3])
        first, second = edges.select("q0").scalar(), edges.select("q1").scalar()
        rate = F.col("inventory_turnover_proxy")
        named = F.when(rate <= first, slow).when(rate <= second, medium).when(rate.isNotNull(), fast)
        result = metrics.withColumn("movement_segment", named)
    return result.select(*by, *SEGMENT_METRICS, "movement_segment")


def segment_table(df: DataFrame, by=("product_id",), method="ntile"):
    return segments(df, by, method).orderBy(F.desc("inventory_turnover_proxy"), *by)


def segment_summary(segmented: DataFrame, digits=None):
    """Means per segment, fastest first; a segment without products shows with 0 of them.

    ``digits`` rounds the per-product stock and risk rate before they are averaged,
    which is what a report built on rounded product rows shows.
    """
    if digits is not None:
        segmented = segmented.withColumns(
            {c: F.round(c, digits) for c in ("avg_inventory", "low_inventory_risk_rate")}
        )
    means = segmented.groupBy("movement_segment").agg(
        M.rows().alias("num_products"),
        M.mean("total_units_sold").alias("avg_total_units_sold"),
        F.avg("avg_inventory").alias("avg_inventory"),
        F.avg("inventory_turnover_proxy").alias("avg_turnover_proxy"),
        F.avg("low_inventory_risk_rate").alias("avg_low_inventory_risk_rate"),
    )
    fastest_first = list(reversed(P.SEGMENTS))
    return reindex(means, "movement_segment", fastest_first).fillna(0, ["num_products"])


def watchlist(segmented: DataFrame, kind, n=P.WATCHLIST_ROWS, key="product_id"):
    """``replenish``: fast movers most often short. ``tied_up``: slow movers with most stock."""
    segment, metric = {
        "replenish": (P.SEGMENTS[2], "low_inventory_risk_rate"),
        "tied_up": (P.SEGMENTS[0], "avg_inventory"),
    }[kind]
    chosen = segmented.filter(F.col("movement_segment") == segment)
    return top_k(chosen, [(metric, "desc"), key], n)


def bubble_sizes(df: DataFrame, by=("product_id",), low=P.BUBBLE_RANGE[0], high=P.BUBBLE_RANGE[1]):
    """Total units sold scaled linearly onto [low, high] over all groups."""
    totals = M.summarize(df, list(by), ["total_units_sold"])
    least = totals.agg(F.min("total_units_sold")).scalar()
    most = totals.agg(F.max("total_units_sold")).scalar()
    value = F.col("total_units_sold")
    scaled = F.try_divide((value - least).cast("double"), (most - least).cast("double"))
    return totals.withColumn("bubble_size", F.lit(low) + F.lit(high - low) * scaled).orderBy(*by)
