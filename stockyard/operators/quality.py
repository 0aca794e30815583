"""Validation and profiling.

Each report is one aggregation over all its columns, not one job per column.
"""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard import params as P
from stockyard import schema as S
from stockyard.functions import classify as C
from stockyard.functions import measures as M
from stockyard.operators.ordering import approximate_quantiles, column_quantiles
from stockyard.session import materialize


def columns_of_type(df: DataFrame, kind):
    """Names of numeric or string columns."""
    wanted = {"numeric": T.NumericType, "string": T.StringType}[kind]
    return [f.name for f in df.schema if isinstance(f.dataType, wanted)]


def to_long(df: DataFrame, columns=None, name="name", value="value", kind=None):
    """Turn the columns of each row into (name, value) rows, in column order."""
    columns = columns or df.columns
    pairs = [
        F.struct(
            F.lit(c).alias(name), (F.col(c).cast(kind) if kind else F.col(c)).alias(value)
        )
        for c in columns
    ]
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(*pairs)))


# --- counts -----------------------------------------------------------------


def row_count(df: DataFrame):
    return df.agg(M.rows().alias("total_rows"))


def date_span(df: DataFrame):
    return df.agg(
        F.min("date").alias("earliest_date"),
        F.max("date").alias("latest_date"),
        F.count_distinct("date").alias("unique_dates"),
    )


CARDINALITY = {
    "stores": "store_id", "products": "product_id", "categories": "category", "regions": "region",
}


def cardinality(df: DataFrame, columns=CARDINALITY, approx=False):
    """Distinct values per column, exact or by sketch (one small state per column)."""
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(*[count(c).alias(name) for name, c in columns.items()])


# The short column names of the null and negative reports.
NULL_LABELS = {
    "date": "null_date", "store_id": "null_store", "product_id": "null_product",
    "category": "null_category", "region": "null_region", "inventory_level": "null_inventory",
    "units_sold": "null_units_sold", "units_ordered": "null_units_ordered",
    "demand_forecast": "null_forecast", "price": "null_price", "discount": "null_discount",
    "weather_condition": "null_weather", "holiday_promotion": "null_holiday",
    "competitor_pricing": "null_competitor_price", "seasonality": "null_seasonality",
}
NEGATIVE_LABELS = {
    "inventory_level": "negative_inventory", "units_sold": "negative_sales",
    "units_ordered": "negative_orders", "demand_forecast": "negative_forecasts",
    "price": "negative_price", "discount": "negative_discount",
    "competitor_pricing": "negative_competitor_price",
}


def null_counts(df: DataFrame, labels=NULL_LABELS):
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(label) for c, label in labels.items()])


def missing_report(df: DataFrame, columns=S.FACT_COLUMNS):
    """(column, missing count, missing percent), most missing first."""
    wide = df.agg(M.rows().alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return (
        to_long(wide, columns, "column_name", "missing_count")
        .withColumn(
            "missing_percentage",
            F.coalesce(F.try_divide(F.lit(100.0) * F.col("missing_count"), F.col("_rows")), F.lit(0.0)),
        )
        .drop("_rows")
        .orderBy(F.desc("missing_count"), "column_name")
    )


def negative_counts(df: DataFrame, labels=NEGATIVE_LABELS):
    return df.agg(*[F.count_if(F.col(c) < 0).alias(label) for c, label in labels.items()])


def zero_counts(df: DataFrame, columns=S.NUMERIC_COLUMNS):
    wide = df.agg(*[F.count_if(F.col(c) == 0).alias(c) for c in columns])
    return to_long(wide, columns, "column_name", "zero_count")


def value_counts(df: DataFrame, column):
    return (
        df.groupBy(column)
        .agg(M.rows().alias("observations"))
        .orderBy(F.desc("observations"), column)
    )


def value_counts_all(df: DataFrame, columns):
    """Value counts of several text columns in one pass, long form."""
    return (
        to_long(df.select(*columns), columns, "column_name", "column_value", "string")
        .groupBy("column_name", "column_value")
        .agg(M.rows().alias("observations"))
    )


def distinct_values(df: DataFrame, column):
    return df.select(column).distinct().orderBy(column)


def peek_dates(df: DataFrame, n=10):
    return df.select("date").distinct().orderBy("date").limit(n)


# --- duplicates -------------------------------------------------------------


def duplicate_keys(df: DataFrame, keys=S.KEYS):
    return (
        df.groupBy(*keys)
        .agg(M.rows().alias("duplicate_count"))
        .filter(F.col("duplicate_count") > 1)
        .orderBy(F.desc("duplicate_count"), *keys)
    )


def _repeated_keys(df, keys):
    """(key, _rows) of keys that occur more than once, stored, so that their size is
    known when the rows are joined to them."""
    counts = df.groupBy(*keys).agg(M.rows().alias("_rows")).filter("_rows > 1")
    return materialize(counts, "repeated_keys")


def _surplus_copies(df, repeated, keys):
    """Surplus full-row copies. Equal rows have equal keys, so only the rows of repeated
    keys are compared in full; the others are never shuffled."""
    marks = repeated.select(*[F.col(k).alias(f"_key_{k}") for k in keys])
    same_key = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    copies = df.join(marks, same_key, "left_semi").groupBy(*df.columns).agg(M.rows().alias("_copies"))
    return copies.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"))


def duplicate_summary(df: DataFrame, keys=S.KEYS):
    """Rows in duplicated keys, surplus rows by key, surplus full-row copies."""
    repeated = _repeated_keys(df, keys)
    copies = _surplus_copies(df, repeated, keys).scalar()
    return repeated.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows_in_duplicated_keys"),
        F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("surplus_key_rows"),
    ).withColumn("duplicate_rows", copies)


def duplicate_key_rows(df: DataFrame, keys=S.KEYS):
    per_key = df.groupBy(*keys).agg(M.rows().alias("_rows"))
    return per_key.agg(
        F.coalesce(F.sum(F.when(F.col("_rows") > 1, F.col("_rows"))), F.lit(0)).alias(
            "rows_in_duplicated_keys"
        ),
        F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("surplus_key_rows"),
    )


def duplicate_rows(df: DataFrame, keys=S.KEYS):
    """Surplus full-row copies; ``keys`` are any columns that tell most rows apart."""
    return _surplus_copies(df, _repeated_keys(df, keys), keys)


# --- distributions ----------------------------------------------------------


def column_types(df: DataFrame):
    """Column name, type, kind and non-null count, in column order."""
    fields = df.schema.fields
    wide = df.agg(*[F.count(f.name).alias(f.name) for f in fields])
    pairs = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.lit(_kind(f.dataType)).alias("kind"),
            F.col(f.name).alias("non_null_count"),
        )
        for i, f in enumerate(fields)
    ]
    return wide.select(F.inline(F.array(*pairs)))


def _kind(data_type):
    if isinstance(data_type, T.NumericType):
        return "numeric"
    return "string" if isinstance(data_type, T.StringType) else "other"


def _moments(df, columns, deviation=True):
    """One row per column: count, mean, sample deviation, extremes; from one scan.

    Whole numbers and decimals are added up exactly, in their own scale; where even 38
    digits don't hold the squares, and for floating point, doubles are used. Without
    ``deviation`` no squares are added up and that column is left out.
    """
    fields, sums, rows = {f.name: f.dataType for f in df.schema}, [], []
    for i, c in enumerate(columns):
        kind, value = fields[c], F.col(c)
        if isinstance(kind, T.IntegralType):
            value = value.cast("decimal(20,0)" if isinstance(kind, T.LongType) else "decimal(10,0)")
        number = F.col(c).cast("double")
        exact = not isinstance(kind, T.FractionalType) or isinstance(kind, T.DecimalType)
        if isinstance(kind, T.IntegralType) and not isinstance(kind, T.LongType):
            summed = F.try_sum(c).cast("decimal(20,0)")  # in a long
        else:
            summed = F.try_sum(value if exact else number)
        sums += [
            F.count(c).alias(f"_n{i}"), F.min(number).alias(f"_min{i}"), F.max(number).alias(f"_max{i}"),
            summed.alias(f"_sum{i}"), F.sum(number).alias(f"_dsum{i}"),
        ]
        if deviation:
            sums += [
                F.try_sum(F.try_multiply(value, value) if exact else number * number).alias(f"_sq{i}"),
                F.sum(number * number).alias(f"_dsq{i}"),
            ]
        n, total, squares = (F.col(f"_{x}{i}") for x in ("n", "sum", "sq"))
        count = n.cast("double")
        plain = count * F.col(f"_dsq{i}") - F.col(f"_dsum{i}") * F.col(f"_dsum{i}")
        whole = F.try_subtract(F.try_multiply(n.cast("decimal(20,0)"), squares), F.try_multiply(total, total))
        spread = F.coalesce(whole.cast("double"), plain) if exact else plain
        rows.append(F.struct(
            F.lit(c).alias("column_name"), n.alias("count"),
            F.try_divide(F.coalesce(total.cast("double"), F.col(f"_dsum{i}")), count).alias("mean"),
            *([F.sqrt(F.try_divide(F.greatest(spread, F.lit(0.0)), count * (count - 1))).alias("std")] if deviation else []),
            F.col(f"_min{i}").alias("min"), F.col(f"_max{i}").alias("max"),
        ))
    return df.agg(M.rows().alias("_rows"), *sums).select(F.inline(F.array(*rows)))


def describe_numeric(df: DataFrame, columns=S.NUMERIC_COLUMNS, approximate=False):
    """Count, mean, sample deviation, extremes and quartiles per numeric column.

    A column without values has count 0 and otherwise NULL. Three scans of the
    profiled columns: moments, brackets, quartiles; ``approximate`` takes the quartiles
    from a sketch instead.
    """
    take = approximate_quantiles if approximate else column_quantiles
    quarters = take(df, columns, [0.25, 0.5, 0.75]).select(
        F.col("name").alias("column_name"), F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75")
    )
    return (
        _moments(df, columns).join(quarters, "column_name", "left")
        .select("column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")
        .orderBy("column_name")
    )


def numeric_summary(df: DataFrame, columns=S.NUMERIC_COLUMNS):
    """Min, max, mean and median per numeric column."""
    middle = column_quantiles(df, columns, [0.5]).select(F.col("name").alias("column_name"), F.col("q0").alias("median"))
    return (
        _moments(df, columns, deviation=False).join(middle, "column_name", "left")
        .select("column_name", "min", "max", "mean", "median").orderBy("column_name")
    )


def describe_strings(df: DataFrame, columns=S.STRING_COLUMNS):
    """Count, distinct, most frequent value and its frequency per text column.

    Equal frequencies: the smallest value. A column without values has counts of 0.
    """
    counts = value_counts_all(df, columns)
    seen = F.col("column_value").isNotNull()
    best = F.min(F.when(seen, F.struct((-F.col("observations")).alias("o"), F.col("column_value").alias("v"))))
    return (
        counts.groupBy("column_name")
        .agg(
            F.coalesce(F.sum(F.when(seen, F.col("observations"))), F.lit(0)).alias("count"),
            F.count_if(seen).alias("unique"),
            best.alias("_best"),
        )
        .select("column_name", "count", "unique", F.col("_best.v").alias("top"), (-F.col("_best.o")).alias("freq"))
        .orderBy("column_name")
    )


def iqr_outliers(df: DataFrame, columns=S.NUMERIC_COLUMNS, fence=P.IQR_FENCE):
    """Quartiles, fences and the rows outside them, per numeric column.

    The percentage is of all rows, also those without a value.
    """
    quarters = {r["name"]: (r["q0"], r["q1"]) for r in column_quantiles(df, columns, [0.25, 0.75]).collect()}
    outside, rows = [], []
    for i, c in enumerate(columns):
        value = F.col(c).cast("double")
        low, high = (F.lit(q).cast("double") for q in quarters.get(c, (None, None)))
        width = F.lit(fence) * (high - low)
        bounds = {"q1": low, "q3": high, "lower_bound": low - width, "upper_bound": high + width}
        outside.append(
            F.count_if((value < bounds["lower_bound"]) | (value > bounds["upper_bound"])).alias(f"_n{i}")
        )
        rows.append(F.struct(
            F.lit(c).alias("column_name"), *[v.alias(x) for x, v in bounds.items()],
            F.col(f"_n{i}").alias("outlier_count"),
            F.try_divide(F.lit(100.0) * F.col(f"_n{i}"), F.col("_rows")).alias("outlier_pct"),
        ))
    return df.agg(M.rows().alias("_rows"), *outside).select(F.inline(F.array(*rows))).orderBy("column_name")


def median(df: DataFrame, column, into="median"):
    """Exact median without a global window over the rows."""
    return column_quantiles(df, [column], [0.5]).select(F.col("q0").alias(into))


def descriptive_stats(df: DataFrame):
    """One row: extremes and means of the main columns, and the median stock."""
    short = [
        ("inventory_level", "inventory"), ("units_sold", "units_sold"),
        ("units_ordered", "units_ordered"), ("demand_forecast", "demand_forecast"),
        ("price", "price"), ("discount", "discount"),
    ]
    wanted = []
    for column, label in short:
        wanted += [
            F.min(column).alias(f"min_{label}"),
            F.max(column).alias(f"max_{label}"),
            M.mean(column).alias(f"avg_{label}"),
        ]
    middle = median(df, "inventory_level").scalar()
    return df.agg(*wanted).withColumn("median_inventory", middle)


# --- negative forecasts (raw data) ------------------------------------------


def _negative(df):
    return df.filter(F.col(C.FORECAST) < 0)


def negative_forecast_diagnostics(df: DataFrame):
    return _negative(df).agg(
        M.rows().alias("negative_forecast_rows"),
        M.mean(C.FORECAST).alias("avg_negative_forecast"),
        F.min(C.FORECAST).alias("min_negative_forecast"),
        F.max(C.FORECAST).alias("max_negative_forecast"),
    )


def negative_forecast_by(df: DataFrame, column):
    return (
        _negative(df)
        .groupBy(column)
        .agg(M.rows().alias("negative_forecast_rows"))
        .orderBy(F.desc("negative_forecast_rows"), column)
    )


def negative_forecast_described(df: DataFrame, columns=("demand_forecast", "units_sold")):
    """Full description of the forecast and the sales on the affected rows."""
    return describe_numeric(_negative(df), list(columns))


# --- summaries --------------------------------------------------------------


# The checks of the summary, in order.
SUMMARY_CHECKS = [
    "Number of rows", "Number of columns", "Missing values", "Duplicate rows",
    "Duplicate business keys", "Invalid dates", "Negative inventory", "Negative units sold",
    "Negative units ordered", "Negative demand forecasts", "Unique stores",
    "Unique products", "Unique categories", "Unique regions", "Unique dates",
]
NEGATIVE_CHECKS = {
    "Negative inventory": "inventory_level", "Negative units sold": "units_sold",
    "Negative units ordered": "units_ordered", "Negative demand forecasts": "demand_forecast",
}
UNIQUE_CHECKS = {
    "Unique stores": "store_id", "Unique products": "product_id", "Unique categories": "category",
    "Unique regions": "region", "Unique dates": "date",
}


def quality_summary(df: DataFrame, keys=S.KEYS):
    """Fifteen (check, result) rows with their order, from two scans.

    Rows are first grouped by business key and content (two 64-bit hashes of all
    columns): counters add up from these groups, and what is distinct is counted over
    groups, not rows; the second scan groups the few columns outside the key.
    """
    columns = [c for c in S.FACT_COLUMNS if c in df.columns]
    missing = sum((F.col(c).isNull().cast("bigint") for c in columns[1:]), F.col(columns[0]).isNull().cast("bigint"))
    content = [F.xxhash64(*columns).alias("_h1"), F.xxhash64(F.lit(1), *reversed(columns)).alias("_h2")]
    negative = {f"_{c}": (F.col(c) < 0).cast("bigint") for c in NEGATIVE_CHECKS.values()}
    unkeyed = [c for c in UNIQUE_CHECKS.values() if c not in keys]
    groups = (
        df.select(*columns, *content, missing.alias("_missing"), *[v.alias(k) for k, v in negative.items()])
        .groupBy(*keys, "_h1", "_h2")
        .agg(M.rows().alias("_n"), F.sum("_missing").alias("_missing"), *[F.sum(k).alias(k) for k in negative])
    )
    per_key = groups.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("_n", "_missing", *negative)], M.rows().alias("_variants")
    )
    others = df.select(*unkeyed).distinct().agg(
        F.struct(*[F.count_distinct(c).alias(c) for c in unkeyed])
    ).scalar()
    totals = per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("Number of rows"),
        F.lit(len(columns)).cast("bigint").alias("Number of columns"),
        F.coalesce(F.sum("_missing"), F.lit(0)).alias("Missing values"),
        F.coalesce(F.sum(F.col("_n") - F.col("_variants")), F.lit(0)).alias("Duplicate rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("Duplicate business keys"),
        F.coalesce(F.sum(F.when(F.col("date").isNull(), F.col("_n"))), F.lit(0)).alias("Invalid dates"),
        *[F.coalesce(F.sum(f"_{c}"), F.lit(0)).alias(name) for name, c in NEGATIVE_CHECKS.items()],
        *[F.count_distinct(c).alias(name) for name, c in UNIQUE_CHECKS.items() if c in keys],
    ).withColumn("_others", others)
    totals = totals.withColumns({name: F.col(f"_others.{c}") for name, c in UNIQUE_CHECKS.items() if c in unkeyed})
    return (
        to_long(totals.select(*SUMMARY_CHECKS), None, "check", "result", "bigint")
        .withColumn("position", C.rank_in("check", SUMMARY_CHECKS)).orderBy("position")
    )


# Determinant -> dependent pairs worth testing before moving a column to a dimension.
DEPENDENCIES = [
    (["product_id"], "category"),
    (["store_id"], "region"),
    (["date", "store_id"], "weather_condition"),
]


def functional_dependency(df: DataFrame, determinant, dependent):
    """How many groups of ``determinant`` hold more than one ``dependent`` value."""
    pairs = df.groupBy(*determinant, dependent).agg(F.lit(1).alias("_one"))
    per_group = pairs.groupBy(*determinant).agg(F.count(dependent).alias("_values"))
    return per_group.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("_values") > 1).alias("violating_groups"),
        F.min("_values").alias("min_values"),
        F.max("_values").alias("max_values"),
    ).select(
        F.lit("+".join(determinant)).alias("determinant"),
        F.lit(dependent).alias("dependent"),
        "*",
    )


def functional_dependencies(df: DataFrame, pairs=DEPENDENCIES):
    reports = [functional_dependency(df, left, right) for left, right in pairs]
    result = reports[0]
    for report in reports[1:]:
        result = result.unionAll(report)
    return result


def foreign_key_check(fact: DataFrame, dimensions):
    """Rows and values of the fact without a parent, per foreign key.

    ``dimensions``: fact column -> (dimension frame, key column). One scan of the
    fact: its key values are counted first, the anti-join sees distinct values.
    """
    columns = list(dimensions)
    used = (
        to_long(fact.select(*columns), columns, "foreign_key", "_value", "string")
        .groupBy("foreign_key", "_value")
        .agg(M.rows().alias("_n"))
    )
    parents = None
    for column, (frame, key) in dimensions.items():
        part = frame.select(F.lit(column).alias("foreign_key"), F.col(key).cast("string").alias("_value"))
        parents = part if parents is None else parents.unionAll(part)
    known = parents.distinct().withColumn("_known", F.lit(True))
    return (
        used.join(known, ["foreign_key", "_value"], "left")
        .groupBy("foreign_key")
        .agg(
            F.sum("_n").alias("checked_rows"),
            F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("orphan_rows"),
            F.count_if(F.col("_known").isNull()).alias("orphan_values"),
        )
        .orderBy("foreign_key")
    )


def orphans(fact: DataFrame, dimension: DataFrame, column, key=None):
    """Fact rows whose ``column`` has no parent in the dimension."""
    parents = dimension.select(F.col(key or column).alias(column)).distinct()
    return fact.join(parents, column, "left_anti")


def share_of_total(counts: DataFrame, column="observations", into="percentage"):
    """Percent of the total over a grouped frame of any size.

    The total is a scalar subquery on the same exchange, not a window over all rows.
    """
    total = counts.agg(F.sum(column)).scalar()
    return counts.withColumn(into, F.try_divide(F.lit(100.0) * F.col(column), total))
