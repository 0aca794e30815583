"""Row-level rules as Column expressions: tiers, statuses, reorder quantities.

Cuts are decimals and the comparison is ``level vs factor * forecast``, so no
row sits on the wrong side of a cut because of a division or a binary fraction.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockyard import params as P

LEVEL, FORECAST, SOLD, ORDERED = "inventory_level", "demand_forecast", "units_sold", "units_ordered"
RISK = "inventory_risk"


def _times(forecast, factor):
    return F.col(forecast) * F.lit(factor)


def risk_tier(cuts=P.CANONICAL_CUTS, level=LEVEL, forecast=FORECAST) -> Column:
    """Four tiers. A missing or zero forecast ends in the last tier."""
    low, mid, high = cuts
    return (
        F.when(F.col(level) < _times(forecast, low), P.RISK_TIERS[0])
        .when(F.col(level) <= _times(forecast, mid), P.RISK_TIERS[1])
        .when(F.col(level) <= _times(forecast, high), P.RISK_TIERS[2])
        .otherwise(P.RISK_TIERS[3])
    )


def rank_in(column, domain) -> Column:
    """1-based position of a value in an ordered domain, NULL if absent."""
    position = F.array_position(F.array(*[F.lit(v) for v in domain]), F.col(column))
    return F.when(position > 0, position.cast("int"))


def overstocked(factor=P.OVERSTOCK_FACTOR) -> Column:
    return F.col(LEVEL) > _times(FORECAST, factor)


def in_balanced_band(band=P.BALANCED_BAND) -> Column:
    return F.col(LEVEL).between(_times(FORECAST, band[0]), _times(FORECAST, band[1]))


def reorder_trigger() -> Column:
    return F.col(LEVEL) < F.col(FORECAST)


def shelf_status(near=P.NEAR_REORDER_FACTOR) -> Column:
    out, below, close, fine = P.SHELF_STATUSES
    return (
        F.when(F.col(LEVEL) == 0, out)
        .when(F.col(LEVEL) < _times(FORECAST, near), below)
        .when(F.col(LEVEL) < F.col(FORECAST), close)
        .otherwise(fine)
    )


def trend_status(reorder_point, level=LEVEL) -> Column:
    out, below, fine = P.TREND_STATUSES
    return (
        F.when(F.col(level) <= 0, out)
        .when(F.col(level) < F.col(reorder_point), below)
        .otherwise(fine)
    )


def order_quantity(buffer=P.BUFFER, gated=True, rounding="half_up") -> Column:
    """Units to order: buffered forecast minus stock, whole units, never negative.

    ``gated`` orders only where the trigger holds. ``rounding`` is ``half_up``
    (decimal rounding of SQL) or ``half_even`` (rounding of a dataframe library).
    """
    whole = {"half_up": F.round, "half_even": F.bround}[rounding]
    gap = whole(_times(FORECAST, buffer) - F.col(LEVEL), 0)
    quantity = F.when(gap > 0, gap).otherwise(0).cast("bigint")
    if not gated:
        return quantity
    return F.when(reorder_trigger(), quantity).otherwise(F.lit(0).cast("bigint"))


def clipped_forecast(forecast=FORECAST) -> Column:
    """Negative forecasts become zero, missing ones stay missing."""
    return F.when(F.col(forecast) < 0, F.lit(0).cast("decimal(10,2)")).otherwise(F.col(forecast))


def forecast_error() -> Column:
    return F.col(SOLD) - F.col(FORECAST)
