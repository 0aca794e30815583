"""Aggregate expressions.

Averages are ``exact total / count``: totals are whole numbers (money in whole
hundredths), and only the total becomes a double. The result does not depend on the
order in which partitions merge, so a retried task cannot change it.

Money is decimal(10,2). Summing it as decimal takes a 20-digit buffer and squaring
an error takes arbitrary-precision arithmetic per row; hundredths in a bigint are
as exact and stay in primitive code. An overflow raises.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockyard.functions import classify as C

MONEY_COLUMNS = {"demand_forecast", "price", "competitor_pricing"}


def rows() -> Column:
    return F.count(F.lit(1))


def hundredths(money) -> Column:
    return F.rint(F.col(money).cast("double") * 100).cast("bigint")


def mean(column) -> Column:
    if column in MONEY_COLUMNS:
        whole = f"CAST(RINT(CAST({column} AS DOUBLE) * 100) AS BIGINT)"
        return F.expr(f"try_divide(CAST(SUM({whole}) AS DOUBLE) / 100, COUNT({column}))")
    return F.expr(f"try_divide(CAST(SUM({column}) AS DOUBLE), COUNT({column}))")


def mean_of_hundredths(value) -> Column:
    return F.try_divide(F.sum(value).cast("double") / 100, F.count(value))


def ratio(top, bottom) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def percent(condition, base=None) -> Column:
    """100 * rows where the condition holds / rows (or ``base``)."""
    return F.try_divide(F.lit(100.0) * F.count_if(condition), rows() if base is None else base)


def tier_percent(position) -> Column:
    """Needs the tier column, so that a row is classified once, not once per tier."""
    return percent(F.col(C.RISK) == C.P.RISK_TIERS[position])


def turnover() -> Column:
    return F.try_divide(mean(C.SOLD), mean(C.LEVEL))


def _error() -> Column:
    return F.col(C.SOLD).cast("bigint") * 100 - hundredths(C.FORECAST)


def _surplus() -> Column:
    return F.col(C.LEVEL).cast("bigint") * 100 - hundredths(C.FORECAST)


def mean_absolute_error() -> Column:
    return mean_of_hundredths(F.abs(_error()))


def root_mean_square_error() -> Column:
    error = _error()
    squares = F.sum((error * error).cast("decimal(19,0)")).cast("double")
    return F.sqrt(F.try_divide(squares / 10000, F.count(error)))


def mean_absolute_percentage_error() -> Column:
    """Rows without sales are left out."""
    share = F.try_divide(F.abs(_error()).cast("double"), F.col(C.SOLD).cast("double"))
    return F.avg(share)


def mean_coverage() -> Column:
    """Mean of stock / forecast over rows with a positive forecast."""
    return F.avg(
        F.when(
            F.col(C.FORECAST) > 0,
            F.try_divide(F.col(C.LEVEL).cast("double"), F.col(C.FORECAST).cast("double")),
        )
    )


def spread(value, sample=False) -> Column:
    """Standard deviation of an integer column from exact sums."""
    x = F.col(value).cast("bigint")
    n = F.count(x).cast("decimal(19,0)")
    total = F.sum(x).cast("decimal(19,0)")
    squares = F.sum(x * x).cast("decimal(19,0)")
    numerator = (n * squares - total * total).cast("double")
    n = n.cast("double")
    denominator = n * (n - 1) if sample else n * n
    return F.sqrt(F.try_divide(numerator, denominator))


# One name per measure; operators pick from here so that a KPI means one thing.
MEASURES = {
    "observations": rows,
    "valid_observations": rows,
    "total_units_sold": lambda: F.sum(C.SOLD),
    "total_units_ordered": lambda: F.sum(C.ORDERED),
    "units_sold": lambda: F.sum(C.SOLD),
    "units_ordered": lambda: F.sum(C.ORDERED),
    "avg_inventory": lambda: mean(C.LEVEL),
    "avg_inventory_level": lambda: mean(C.LEVEL),
    "avg_demand_forecast": lambda: mean(C.FORECAST),
    "avg_units_sold": lambda: mean(C.SOLD),
    "avg_units_ordered": lambda: mean(C.ORDERED),
    "avg_price": lambda: mean("price"),
    "inventory_turnover_proxy": turnover,
    "inventory_to_sales_ratio": lambda: ratio(F.sum(C.LEVEL), F.sum(C.SOLD)),
    "order_to_sales_ratio": lambda: ratio(F.sum(C.ORDERED), F.sum(C.SOLD)),
    "sales_to_order_pct": lambda: ratio(F.lit(100) * F.sum(C.SOLD), F.sum(C.ORDERED)),
    "sell_through_rate": lambda: ratio(
        F.lit(100) * F.sum(C.SOLD), F.sum(C.SOLD) + F.sum(C.ORDERED)
    ),
    "avg_inventory_coverage": mean_coverage,
    "understocked_pct": lambda: tier_percent(0),
    "balanced_pct": lambda: tier_percent(1),
    "high_inventory_pct": lambda: tier_percent(2),
    "excess_inventory_pct": lambda: tier_percent(3),
    "low_inventory_risk_rate": lambda: percent(C.reorder_trigger()),
    "active_selling_days": lambda: F.count_if(F.col(C.SOLD) > 0),
    "mae": mean_absolute_error,
    "rmse": root_mean_square_error,
    "mape": mean_absolute_percentage_error,
    "avg_inventory_gap": lambda: mean_of_hundredths(-_surplus()),
    "avg_inventory_surplus": lambda: mean_of_hundredths(_surplus()),
}


def measure(name) -> Column:
    return MEASURES[name]().alias(name)


def summarize(df, by, names):
    """One row per group of ``by`` (one row overall if empty) with named measures."""
    return df.groupBy(*by).agg(*[measure(n) for n in names])
