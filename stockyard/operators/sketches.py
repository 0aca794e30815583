"""Profiles from stored summaries: one row per period, merged for any span of periods.

A period's row holds, for every numeric column, exact sums (count, extremes, total, squares) and
a KLL sketch of its quantiles; for every column to be counted, an HLL sketch of its distinct
values. They are built in one scan, combined by each task before the shuffle, and a period
that is loaded anew replaces its row alone. Merging reads the rows of the summary, not the fact.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard import schema as S
from stockyard.functions import measures as M
from stockyard.operators.ordering import bracket_ends, bracketed_quantiles
from stockyard.operators.quality import to_long

PERIOD = "period"
KLL_K = 2048        # a rank is off by some 0.2 percent, then
KLL_MARGIN = 0.006  # what a bracket allows for, three times that; a miss raises an error
HLL_BITS = 14       # 2 ** bits registers: a relative standard error of 1.04 / 2 ** (bits / 2)
HLL_ERROR = 1.04 / 2 ** (HLL_BITS / 2)


def _scale(kind):
    if isinstance(kind, T.IntegralType):
        return 0
    if isinstance(kind, T.DecimalType):
        return kind.scale
    raise TypeError(f"sums of {kind.simpleString()} are not exact")


def _whole(df, column):
    """The column as a whole number of its smallest unit."""
    scale = _scale(df.schema[column].dataType)
    return (F.col(column).cast("decimal(19,4)") * F.lit(10**scale)).cast("decimal(19,0)")


def build(df: DataFrame, numeric=S.NUMERIC_COLUMNS, distinct=S.STRING_COLUMNS, grain=S.MONTH):
    """One summary row for each period (month or year) of the date; rows without a date are in
    a row of their own, whose period is null."""
    summaries = [M.rows().alias("rows")]
    for c in numeric:
        value, whole = F.col(c).cast("double"), _whole(df, c)
        summaries += [
            F.count(c).alias(f"n_{c}"), F.min(value).alias(f"min_{c}"), F.max(value).alias(f"max_{c}"),
            F.sum(whole).cast("decimal(38,0)").alias(f"sum_{c}"),
            F.sum((whole * whole).cast("decimal(38,0)")).cast("decimal(38,0)").alias(f"sq_{c}"),
            F.kll_sketch_agg_double(value, F.lit(KLL_K)).alias(f"kll_{c}"),
        ]
    summaries += [F.hll_sketch_agg(c, F.lit(HLL_BITS)).alias(f"hll_{c}") for c in distinct]
    return df.groupBy(F.trunc("date", S.GRAINS[grain]).alias(PERIOD)).agg(*summaries)


def store(df: DataFrame, path, numeric=S.NUMERIC_COLUMNS, distinct=S.STRING_COLUMNS, grain=S.MONTH):
    """Write the summaries of a fact, a folder for each period."""
    summaries = build(df, numeric, distinct, grain)
    summaries.write.partitionBy(PERIOD).mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return path


def refresh(df: DataFrame, path, periods, numeric=S.NUMERIC_COLUMNS, distinct=S.STRING_COLUMNS, grain=S.MONTH):
    """Replace the summaries of some periods (first days) by those of the rows ``df`` has of
    them; a period that has no more rows keeps no summary with rows."""
    spark, unit = df.sparkSession, S.GRAINS[grain]
    wanted = [F.lit(p).cast("date") for p in periods]
    rows = df.filter(F.trunc("date", unit).isin(wanted))
    if grain in df.columns:
        rows = rows.filter(F.col(grain).isin(wanted))
    fresh = build(rows, numeric, distinct, grain)
    empty = spark.range(1).select(F.explode(F.array(*wanted)).alias(PERIOD))
    found = empty.join(fresh, PERIOD, "left").fillna({"rows": 0})
    found.write.partitionBy(PERIOD).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return path


def read(spark, path, since=None, until=None):
    """Stored summaries, of all periods or of those that begin between two days."""
    return within(spark.read.parquet(path), since, until)


def within(summaries: DataFrame, since=None, until=None, column=PERIOD):
    """Rows whose period begins from ``since`` to ``until``."""
    if since is not None:
        summaries = summaries.filter(F.col(column) >= F.lit(since).cast("date"))
    if until is not None:
        summaries = summaries.filter(F.col(column) <= F.lit(until).cast("date"))
    return summaries


def of_periods(df: DataFrame, since=None, until=None, grain=S.MONTH):
    """Rows of the fact that the summaries of these periods stand for; a stored period
    column prunes the others."""
    if since is None and until is None:
        return df
    if grain in df.columns:
        df = within(df, since, until, grain)
    return within(df.withColumn("_period", F.trunc("date", S.GRAINS[grain])), since, until, "_period").drop("_period")


def distinct_estimates(summaries: DataFrame, columns=S.STRING_COLUMNS):
    """(column_name, distinct_estimate): unions of the stored sketches. The standard error is
    ``HLL_ERROR`` of the number; the exact counts are those of ``quality.cardinality``."""
    wide = summaries.agg(*[F.hll_sketch_estimate(F.hll_union_agg(f"hll_{c}")).alias(c) for c in columns])
    return to_long(wide, columns, "column_name", "distinct_estimate")


def _brackets(summaries, columns, ends):
    """One array of bracket ends for each column, as a subquery of one value."""
    picked = [
        F.when(F.col(f"_n_{c}") > 0, F.kll_sketch_get_quantile_double(F.col(f"_kll_{c}"), F.array(*map(F.lit, ends))))
        for c in columns
    ]
    merged = summaries.filter("rows > 0").agg(*[
        x for c in columns
        for x in (F.kll_merge_agg_double(f"kll_{c}").alias(f"_kll_{c}"), F.sum(f"n_{c}").alias(f"_n_{c}"))
    ])
    return merged.select(F.array(*picked)).scalar()


def quantiles(df: DataFrame, summaries: DataFrame, columns, probabilities, margin=KLL_MARGIN):
    """Exact quantiles: brackets from the merged sketches, then one scan inside them.

    ``df`` holds the rows that the summaries stand for (see ``of_periods``). No job runs before
    the frame does: the brackets are a subquery of its plan. Same shape as ``column_quantiles``.
    """
    found = _brackets(summaries, columns, bracket_ends(probabilities, margin))
    rows = df.select(*columns, found.alias("_brackets"))
    bounds = [
        [F.col("_brackets")[i][e] for e in range(2 * len(probabilities))] for i in range(len(columns))
    ]
    return bracketed_quantiles(rows, columns, probabilities, bounds, ["_brackets"])


def moments(summaries: DataFrame, schema, columns):
    """One row per column: count, mean, sample deviation and extremes, from the stored sums."""
    sums, rows = [], []
    for i, c in enumerate(columns):
        sums += [
            F.coalesce(F.sum(f"n_{c}"), F.lit(0)).alias(f"_n{i}"), F.min(f"min_{c}").alias(f"_min{i}"),
            F.max(f"max_{c}").alias(f"_max{i}"), F.sum(f"sum_{c}").cast("decimal(38,0)").alias(f"_sum{i}"),
            F.sum(f"sq_{c}").cast("decimal(38,0)").alias(f"_sq{i}"),
        ]
        unit = float(10 ** _scale(schema[c].dataType))
        n, total, squares = (F.col(f"_{x}{i}") for x in ("n", "sum", "sq"))
        count = n.cast("double")
        # in whole numbers while 38 digits hold them
        spread = F.coalesce(
            F.try_subtract(F.try_multiply(n.cast("decimal(19,0)"), squares), F.try_multiply(total, total)).cast("double"),
            count * squares.cast("double") - total.cast("double") * total.cast("double"),
        )
        rows.append(F.struct(
            F.lit(c).alias("column_name"), n.alias("count"), F.try_divide(total.cast("double") / unit, count).alias("mean"),
            F.sqrt(F.try_divide(F.greatest(spread, F.lit(0.0)), count * (count - 1)) / (unit * unit)).alias("std"),
            F.col(f"_min{i}").alias("min"), F.col(f"_max{i}").alias("max"),
        ))
    return summaries.agg(*sums).select(F.inline(F.array(*rows)))


def describe(df: DataFrame, summaries: DataFrame, columns=S.NUMERIC_COLUMNS):
    """As ``quality.describe_numeric``, exact, from one scan of the fact: moments come from the
    summaries alone, and so do the brackets around the quartiles."""
    quarters = quantiles(df, summaries, columns, [0.25, 0.5, 0.75]).select(
        F.col("name").alias("column_name"), F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75")
    )
    return (
        moments(summaries, df.schema, columns).join(quarters, "column_name", "left")
        .select("column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")
        .orderBy("column_name")
    )


# --- frequent values --------------------------------------------------------

TRACKED = 8192     # items that a summary of frequent values holds, at most
CANDIDATES = 1024  # of these, how many are counted exactly
FREQUENT_ERROR = 3.5  # of n / TRACKED: what the summary's counts may be off by


def frequent_values(df: DataFrame, columns, k=20, tracked=TRACKED, candidates=CANDIDATES):
    """(column_name, column_value, observations, certain): the most frequent values of wide columns.

    One scan keeps a heavy-hitter summary of each column, so a task sends one summary and the
    shuffle does not grow with the number of values. A second scan counts the summaries'
    candidates exactly, against a broadcast of at most ``candidates`` values a column. A value
    that is no candidate occurs at most as often as the last candidate's estimate plus the
    summary's error; what occurs more often is ``certain`` to be in its place, the rest may
    lack values of ``quality.value_counts`` that are about as frequent. Missing values don't count.
    """
    text = to_long(df.select(*columns), columns, "column_name", "column_value", "string")
    text = text.filter(F.col("column_value").isNotNull())
    summary = text.groupBy("column_name").agg(
        F.expr(f"approx_top_k(column_value, {int(candidates)}, {int(tracked)})").alias("_top"), M.rows().alias("_n")
    )
    beyond = F.when(F.size("_top") >= candidates, F.array_min(F.transform("_top", lambda x: x["count"]))).otherwise(0)
    error = F.col("_n") * F.lit(FREQUENT_ERROR / tracked)
    found = summary.select("column_name", (beyond + error).alias("_most"), F.explode("_top.item").alias("column_value"))
    counted = (
        text.join(F.broadcast(found), ["column_name", "column_value"])
        .groupBy("column_name", "column_value")
        .agg(M.rows().alias("observations"), F.first("_most").alias("_most"))
    )
    place = F.row_number().over(
        Window.partitionBy("column_name").orderBy(F.desc("observations"), "column_value")
    )
    return (
        counted.withColumn("_place", place).filter(F.col("_place") <= k)
        .select("column_name", "column_value", "observations", (F.col("observations") > F.col("_most")).alias("certain"))
        .orderBy("column_name", F.desc("observations"), "column_value")
    )
