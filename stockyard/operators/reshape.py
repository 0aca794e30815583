"""Pivots, crosstabs, fixed domains, selections, labels, samples."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard import params as P
from stockyard import schema as S
from stockyard.functions import classify as C
from stockyard.functions import measures as M


def pivot_mean(df: DataFrame, row, column, value=C.SOLD, columns=None):
    """Mean of ``value`` with ``row`` down and the values of ``column`` across.

    Given ``columns`` (a list, or a frame of one column such as a stored dimension) it
    is one conditional aggregation. Without them Spark first runs a distinct over
    ``column`` to learn the output schema.
    """
    if isinstance(columns, DataFrame):
        columns = [r[0] for r in columns.orderBy(columns.columns[0]).collect()]
    pivot = df.groupBy(row).pivot(column, columns) if columns else df.groupBy(row).pivot(column)
    return pivot.agg(M.mean(value)).orderBy(row)


def reindex(df: DataFrame, column, domain, fill=None):
    """Force ``column`` onto an ordered list of values; absent ones get ``fill``."""
    spark = df.sparkSession
    kind = df.schema[column].dataType.simpleString()
    frame = spark.createDataFrame(
        [(v, i) for i, v in enumerate(domain, 1)], f"`{column}` {kind}, position int"
    )
    result = frame.join(df, column, "left")
    if fill is not None:
        result = result.fillna(fill)
    return result.orderBy("position").select(*df.columns)


def pivot_season_category(df: DataFrame, categories=None):
    """Season x category mean sales, seasons in calendar order."""
    return reindex(pivot_mean(df, "seasonality", "category", columns=categories), "seasonality", P.SEASONS)


def crosstab_status(df: DataFrame, row="store_id"):
    """Rows per store and shelf status; every status is a column, absent ones are 0."""
    status = C.shelf_status()
    counts = [
        F.count_if(status == label).alias(label.lower().replace(" ", "_"))
        for label in P.SHELF_STATUSES
    ]
    return df.groupBy(row).agg(*counts).orderBy(row)


def select_where(df: DataFrame, **choices):
    """Optional equality filters; None or "All" leaves a column unfiltered."""
    for column, value in choices.items():
        if value is not None and value != "All":
            df = df.filter(F.col(column) == F.lit(value))
    return df


def with_label(df: DataFrame, columns=("store_id", "product_id"), into="label"):
    return df.withColumn(into, F.concat_ws(" · ", *columns))


def sample_rows(df: DataFrame, n=P.SAMPLE_ROWS, seed=P.SAMPLE_SEED, keys=S.KEYS):
    """At most ``n`` rows, the same ones on every run: smallest hashes of the key."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return df.withColumn("_h", F.md5(text.cast("binary"))).orderBy("_h", *keys).limit(n).drop("_h")


def max_of_columns(df: DataFrame, columns=(C.FORECAST, C.LEVEL), into="max_value"):
    """Largest value of several columns of the rows shown, such as ``sample_rows``."""
    tops = [F.max(c).cast("double") for c in columns]
    return df.agg(F.greatest(*tops).alias(into))


def preview(df: DataFrame, n=5, keys=S.KEYS):
    """First rows in key order, so that the preview is the same every time."""
    return df.orderBy(*keys).limit(n)
