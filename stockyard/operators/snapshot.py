"""Point-in-time and trailing-window views of the fact.

The latest date is a scalar subquery, which Spark evaluates first and pushes into
the scan as a literal. A stored fact carries a month or year partition column: the
newest period is found from the partitions, the latest date inside it, and the same
bound on the period prunes all others.
"""

import datetime
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard import params as P
from stockyard import schema as S


def reference_date(df: DataFrame, as_of=None, shape=lambda day: day):
    """``shape`` of the reference date: ``as_of``, or the latest date of the fact.

    The shaping happens inside the scalar subquery, so what reaches the scan is a
    plain comparison that Parquet filters and partition pruning understand.
    """
    if as_of is None:
        for column in S.GRAINS:
            if column in df.columns:
                df = df.filter(F.col(column) == df.agg(F.max(column)).scalar())
        return df.agg(shape(F.max("date"))).scalar()
    if isinstance(as_of, str):
        as_of = datetime.date.fromisoformat(as_of)
    return shape(F.lit(as_of))


def previous_date(df: DataFrame, as_of=None, shape=lambda day: day):
    """``shape`` of the last date before the reference date that the fact holds.

    With stored periods it is looked for in the reference date's period, and only if
    that holds none in the newest period before; all others are pruned.
    """
    before = df.filter(F.col("date") < reference_date(df, as_of))
    stored = [(column, unit) for column, unit in S.GRAINS.items() if column in df.columns]
    if not stored:
        return before.agg(shape(F.max("date"))).scalar()
    column, unit = stored[0]
    period = reference_date(df, as_of, lambda day: F.trunc(day, unit))
    older = df.filter(F.col(column) < period)
    older = older.filter(F.col(column) == older.agg(F.max(column)).scalar())
    found = [rows.agg(shape(F.max("date"))).scalar() for rows in (before.filter(F.col(column) == period), older)]
    return F.coalesce(*found)


def _compare(df, as_of, op, shift=lambda day: day):
    """``op(date, reference)``, with the same bound on the partition column if stored."""
    rows = df.filter(op(F.col("date"), reference_date(df, as_of, shift)))
    for column, unit in S.GRAINS.items():
        if column in df.columns:
            # A strict date bound still needs the period the bound falls in.
            loose = {operator.gt: operator.ge}.get(op, op)
            period = reference_date(df, as_of, lambda day, u=unit: F.trunc(shift(day), u))
            rows = rows.filter(loose(F.col(column), period))
    return rows


def latest_snapshot(df: DataFrame, as_of=None):
    """Rows of the latest date, or of ``as_of``."""
    return _compare(df, as_of, operator.eq)


def trailing_window(df: DataFrame, days=P.TRAILING_DAYS, as_of=None):
    """Rows later than ``days`` days before the reference date.

    With ``as_of`` the rows after it are left out.
    """
    rows = _compare(df, as_of, operator.gt, lambda day: F.date_sub(day, days))
    return rows if as_of is None else _compare(rows, as_of, operator.le)
