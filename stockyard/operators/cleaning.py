"""Cleaning: forecasts clipped at zero, one row per business key."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard import schema as S
from stockyard.functions import classify as C
from stockyard.functions import dates as D
from stockyard.functions import measures as M
from stockyard.operators.ordering import first_per_key


def clip_negative_forecast(df: DataFrame):
    return df.withColumn(C.FORECAST, C.clipped_forecast())


def clip_report(df: DataFrame):
    """Row and negative-forecast counts before and after clipping, in one pass."""
    after = C.clipped_forecast()
    return df.agg(
        F.count_if(F.col(C.FORECAST) < 0).alias("negative_before"),
        F.count_if(after < 0).alias("negative_after"),
        M.rows().alias("rows_before"),
        M.rows().alias("rows_after"),
    )


def clean(df: DataFrame, keys=S.KEYS, tie_break=None):
    """Raw rows to fact rows. Without ``tie_break`` the other columns decide."""
    order = tie_break or [c for c in df.columns if c not in keys]
    return clip_negative_forecast(first_per_key(df, keys, order)).select(*S.FACT_COLUMNS)


def with_time_features(df: DataFrame):
    """Year, month, month name, day name and ISO week of the date."""
    day = F.col("date")
    return df.withColumns(
        {
            "year": F.year(day),
            "month": F.month(day),
            "month_name": F.date_format(day, "MMMM"),
            "day_of_week": F.date_format(day, "EEEE"),
            "week": F.weekofyear(day),
        }
    )


def with_forecast_error(df: DataFrame):
    """Signed, absolute and percentage error; the percentage is of the forecast."""
    error = C.forecast_error()
    share = F.try_divide(F.abs(error).cast("double"), F.col(C.FORECAST).cast("double")) * 100
    return df.withColumns(
        {
            "forecast_error": error,
            "absolute_forecast_error": F.abs(error),
            "forecast_error_pct": F.when(F.col(C.FORECAST) > 0, share),
        }
    )


def valid_forecasts(df: DataFrame):
    return df.filter(F.col(C.FORECAST) >= 0)


def valid_forecast_counts(df: DataFrame):
    valid = F.count_if(F.col(C.FORECAST) >= 0)
    return df.agg(
        M.rows().alias("total_observations"),
        valid.alias("valid_observations"),
        (M.rows() - valid).alias("invalid_observations"),
    )


def parse_dates(df: DataFrame, column="date", strict=True, fmt=D.ISO):
    parse = D.strict_date if strict else D.lenient_date
    return df.withColumn(column, parse(column, fmt))


def invalid_date_count(df: DataFrame, column="date", fmt=D.ISO):
    """Rows whose date text does not parse (or is missing)."""
    return df.agg(
        M.rows().alias("total_rows"),
        F.count_if(D.lenient_date(column, fmt).isNull()).alias("invalid_dates"),
    )


def format_dates(df: DataFrame, column="date"):
    return df.withColumn(column, D.iso_text(column))
