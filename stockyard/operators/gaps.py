"""Gaps and islands in the dates of a fact, without a calendar.

The dates of each group are made distinct first, combined by each task before the shuffle, so
a window holds at most one row per day of a group, however many rows the group has. No
product of dates and keys is built: a gap is seen from the two dates around it.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAIR = ("store_id", "product_id")


def _dates(df, by):
    return df.select(*by, "date").filter(F.col("date").isNotNull()).distinct()


def date_gaps(df: DataFrame, by=PAIR, longer_than=0):
    """(by.., gap_start, gap_end, missing_days): runs of days without a row between a group's
    first and last date. With ``by`` empty, days on which the whole fact has none.
    ``longer_than`` leaves out gaps of up to that many days."""
    before = F.lag("date").over(W.partitionBy(*by).orderBy("date"))
    missing = F.date_diff("date", "_before") - 1
    return (
        _dates(df, by).withColumn("_before", before).filter(missing > longer_than)
        .select(
            *by, F.date_add("_before", 1).alias("gap_start"), F.date_sub("date", 1).alias("gap_end"),
            missing.alias("missing_days"),
        )
        .orderBy(F.desc("missing_days"), *by, "gap_start")
    )


def date_islands(df: DataFrame, by=PAIR):
    """(by.., island_start, island_end, days): runs of consecutive days with rows. In a run,
    a date less its number among the group's dates is always the same."""
    number = F.row_number().over(W.partitionBy(*by).orderBy("date"))
    return (
        _dates(df, by).withColumn("_run", F.date_sub("date", number))
        .groupBy(*by, "_run")
        .agg(F.min("date").alias("island_start"), F.max("date").alias("island_end"), F.count("*").alias("days"))
        .drop("_run").orderBy(F.desc("days"), *by, "island_start")
    )


def date_coverage(df: DataFrame, by=PAIR):
    """First and last date of each group, days with rows, days without, and the longest gap."""
    before = F.lag("date").over(W.partitionBy(*by).orderBy("date"))
    span = F.date_diff(F.max("date"), F.min("date")) + 1
    return (
        _dates(df, by).withColumn("_gap", F.date_diff("date", before) - 1)
        .groupBy(*by)
        .agg(
            F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("date").alias("days_present"),
            (span - F.count("date")).alias("days_missing"), F.coalesce(F.max("_gap"), F.lit(0)).alias("longest_gap"),
        )
        .orderBy(F.desc("days_missing"), *by)
    )
