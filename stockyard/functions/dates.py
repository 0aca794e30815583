"""Date expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd"


def strict_date(text, fmt=ISO) -> Column:
    """String to date; a bad value fails the query, in ANSI mode or not."""
    failure = F.raise_error(F.concat(F.lit("not a date: "), F.col(text))).cast("date")
    parsed = F.try_to_date(F.col(text), fmt)
    return F.when(F.col(text).isNotNull(), F.coalesce(parsed, failure))


def lenient_date(text, fmt=ISO) -> Column:
    """String to date; a bad value becomes NULL."""
    return F.try_to_date(F.col(text), fmt)


def iso_text(date="date") -> Column:
    return F.date_format(F.col(date), ISO)
