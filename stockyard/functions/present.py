"""Reports with the customary number of decimals."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Decimals per report column; other columns stay as they are.
EXACT_NAMES = {
    "lead_time_demand": 1,
    "safety_stock": 1,
    "reorder_point_trend_based": 0,
    "avg_total_units_sold": 0,
    "inventory_turnover_proxy": 3,
    "avg_turnover_proxy": 3,
    "order_to_sales_ratio": 3,
    "inventory_to_sales_ratio": 2,
    "sell_through_rate": 2,
    "low_inventory_risk_rate": 2,
    "overstock_risk_rate": 2,
    "inventory_efficiency": 2,
    "median_inventory": 2,
    "percentage": 2,
    "mae": 2,
    "rmse": 2,
    "mape": 2,
}
PREFIXES = {"avg_": 2, "stddev_": 2}
SUFFIXES = {"_pct": 2}


def digits_of(column):
    if column in EXACT_NAMES:
        return EXACT_NAMES[column]
    for prefix, digits in PREFIXES.items():
        if column.startswith(prefix):
            return digits
    for suffix, digits in SUFFIXES.items():
        if column.endswith(suffix):
            return digits
    return None


def report_view(df: DataFrame):
    """Round the known report columns half away from zero, keep row order."""
    return df.select(
        *[
            F.col(c) if digits_of(c) is None else F.round(F.col(c), digits_of(c)).alias(c)
            for c in df.columns
        ]
    )
