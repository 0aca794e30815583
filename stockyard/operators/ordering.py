"""Global order without a global window: running totals, ranks, tiles, quantiles.

A window without PARTITION BY moves every row to one task. Here the rows are
range-sorted across tasks, each keeps its task's number and its place in it, and
one total per task gives the offsets. The sort key must be unique, so a value
shared by a third of the rows is still spread over tasks by the rest of the key.
"""

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.session import materialize


def place(df: DataFrame, order):
    """Store the rows in global ``order`` with their place and the slice they lie in.

    ``order`` holds columns or (column, "desc") pairs. Written once: the slices must
    be the same for the totals and for the rows.
    """
    keys = [F.desc(o[0]) if isinstance(o, tuple) else F.asc(o) for o in order]
    return materialize(
        df.orderBy(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_place", 33)),
        "ordered",
    )


def accumulate(placed: DataFrame, weight=None, into="running_total"):
    """Add the inclusive running sum of ``weight`` (row count if None) to placed rows.

    Also adds ``grand_total``.
    """
    weight_of = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    slices = placed.groupBy("_slice").agg(F.sum(weight_of).alias("_slice_total"))
    # One row per task of the sort, so this window stays small at any scale.
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select(
        "_slice",
        F.coalesce(F.sum("_slice_total").over(before), F.lit(0)).alias("_offset"),
        F.sum("_slice_total").over(W.partitionBy()).alias("grand_total"),
    )
    within = W.partitionBy("_slice").orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    return (
        placed.withColumn("_within", F.sum(weight_of).over(within))
        .join(F.broadcast(slices), "_slice")  # one row per sort task
        .withColumn(into, F.col("_within") + F.col("_offset"))
        .drop("_place", "_slice", "_within", "_offset")
    )


def group_offsets(placed: DataFrame, group, weight=None):
    """(group, _size, _base) for rows placed by ``group`` first: the weight of the group
    and of all groups before it. For a handful of groups."""
    weight_of = F.lit(1) if weight is None else F.col(weight)
    before = W.orderBy(group).rowsBetween(W.unboundedPreceding, -1)
    return (
        placed.groupBy(group)
        .agg(F.sum(weight_of).cast("bigint").alias("_size"))
        .withColumn("_base", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    )


def running_total(df: DataFrame, order, weight=None, into="running_total"):
    return accumulate(place(df, order), weight, into)


def ntile(df: DataFrame, tiles, order, into="tile"):
    """SQL NTILE over the whole frame: the first ``n % tiles`` tiles get one row more."""
    ranked = running_total(df, order, into="_rank")
    size = F.expr(f"grand_total div {tiles}")
    extra = F.col("grand_total") % tiles
    row = F.col("_rank") - 1
    big = extra * (size + 1)
    tile = F.when(row < big, F.expr(f"(_rank - 1) div (grand_total div {tiles} + 1)")).otherwise(
        extra + F.floor(F.try_divide((row - big).cast("double"), size.cast("double")))
    )
    return ranked.withColumn(into, (tile + 1).cast("int")).drop("_rank", "grand_total")


KLL_K = 8000  # at accuracy 1000: a rank is off by 0.07 percent at 99 percent, a bracket allows three times that


def column_quantiles(df: DataFrame, columns, probabilities, accuracy=1000):
    """Exact linear-interpolated quantiles of numeric columns, in two scans.

    One row per column that holds values: ``name`` and ``q0, q1, ..`` in the order of
    ``probabilities``. The first scan brackets each quantile by a
    mergeable sketch, whose error in rank is ``n / accuracy`` at most; the second is that
    of ``bracketed_quantiles``. Whole numbers and decimals go to KLL sketches, which take a
    third of the time; these leave out NaN, so floating point keeps the other sketch.
    """
    ends = bracket_ends(probabilities, 2.0 / accuracy)
    sketches, brackets, k = [], [], KLL_K * accuracy // 1000
    for i, c in enumerate(columns):
        value = F.col(c).cast("double")
        if 8 <= k <= 65535 and isinstance(df.select(c).schema[0].dataType, (T.IntegralType, T.DecimalType)):
            sketches += [F.kll_sketch_agg_double(value, F.lit(k)).alias(f"s{i}"), F.count(c).alias(f"n{i}")]
            found = F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", F.array(*map(F.lit, ends))))
        else:
            sketches.append(F.percentile_approx(value, ends, accuracy).alias(f"s{i}"))
            found = F.col(f"s{i}")
        brackets.append(found.alias(f"b{i}"))
    # one row of a few numbers; as literals they keep the second scan in compiled code
    bounds = df.agg(*sketches).select(*brackets).first()
    known = [None if bounds[f"b{i}"] is None else [F.lit(x) for x in bounds[f"b{i}"]] for i in range(len(columns))]
    return bracketed_quantiles(df, columns, probabilities, known)


def bracket_ends(probabilities, margin):
    """Ranks around each probability, two for each, in order."""
    return [min(max(float(p) + side, 0.0), 1.0) for p in probabilities for side in (-margin, margin)]


def bracketed_quantiles(df: DataFrame, columns, probabilities, bounds, extra=()):
    """Exact quantiles of columns for which brackets around each are known, in one scan.

    ``bounds`` holds, for each column, the expressions of the two ends of each bracket (or
    None for a column without values), which may refer to ``extra`` columns. Counts the values inside brackets one by one, and
    between brackets only how many there are, the least and the largest. So what is grouped
    follows the brackets, a hot value is one row per task, and nothing is sorted as a
    whole or stored. A bracket that misses its quantile raises an error.
    """
    probabilities, cells = [float(p) for p in probabilities], []
    for i, (c, ends) in enumerate(zip(columns, bounds)):
        if ends is None:
            continue
        value = F.col("x")  # cast once
        bracket = [(ends[2 * p], ends[2 * p + 1]) for p in range(len(probabilities))]
        inside = reduce(or_, [value.between(low, high) for low, high in bracket])
        gap = reduce(add, [(value > high).cast("int") for _, high in bracket])
        cells.append(
            df.select(F.col(c).cast("double").alias("x"), *extra).filter(F.col("x").isNotNull())
            .select("x", F.when(inside, -1).otherwise(gap).alias("gap"), F.when(inside, value).alias("value"))
            .groupBy("gap", "value")
            .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
            .select(F.lit(i).alias("i"), "n", "low", "high")
        )
    if not cells:
        kinds = ", ".join(["name string", *[f"q{k} double" for k in range(len(probabilities))]])
        return df.sparkSession.createDataFrame([], kinds)
    # a column is read for itself, so all in all the columns are read once
    counts = reduce(DataFrame.unionAll, cells)
    within = W.partitionBy("i")  # the values near a few quantiles
    ranked = counts.select(
        "i", "n", "low", "high",
        F.sum("n").over(within.orderBy("low").rowsBetween(W.unboundedPreceding, 0)).alias("_end"),
        F.sum("n").over(within).alias("_size"),
    )
    picks = []
    missed = F.raise_error(F.lit("a bracket misses its quantile: the sketch is too coarse")).cast("double")
    for k, p in enumerate(probabilities):
        position = (F.col("_size") - 1).cast("double") * F.lit(p)
        for side, rank in (("low", F.floor(position)), ("high", F.ceil(position))):
            covers = (F.col("_end") - F.col("n") <= rank) & (rank < F.col("_end"))
            # a rank in a gap is its first or its last: the bracket misses by less than one
            value = (
                F.when(rank == F.col("_end") - F.col("n"), F.col("low"))
                .when((rank == F.col("_end") - 1) | (F.col("low") == F.col("high")), F.col("high")).otherwise(missed)
            )
            picks.append(F.max(F.when(covers, value)).alias(f"_{side}{k}"))
    picked = ranked.groupBy("i", "_size").agg(*picks)
    result = [F.array(*[F.lit(c) for c in columns])[F.col("i")].alias("name")]
    for k, p in enumerate(probabilities):
        position = (F.col("_size") - 1).cast("double") * F.lit(p)
        low, high = F.col(f"_low{k}"), F.col(f"_high{k}")
        result.append((low + (high - low) * (position - F.floor(position))).alias(f"q{k}"))
    return picked.select(*result)


def approximate_quantiles(df: DataFrame, columns, probabilities, accuracy=10_000):
    """Quantiles from one mergeable sketch per column: one pass, small states.

    The error in rank is at most ``rows / accuracy``. Same shape as ``quantiles``.
    """
    wide = df.agg(
        *[F.percentile_approx(F.col(c).cast("double"), list(probabilities), accuracy).alias(c) for c in columns]
    )
    pairs = [F.struct(F.lit(c).alias("name"), F.col(c).alias("q")) for c in columns]
    return wide.select(F.inline(F.array(*pairs))).select(
        "name", *[F.col("q")[i].alias(f"q{i}") for i in range(len(probabilities))]
    )


def top_k(df: DataFrame, order, k):
    """First k rows in order. Each task keeps k rows; no full sort."""
    keys = [F.desc(o[0]) if isinstance(o, tuple) else F.asc(o) for o in order]
    return df.orderBy(*keys).limit(k)


def first_per_key(df: DataFrame, keys, order):
    """Keep one row per key: the first in ``order``.

    Catalyst limits each key to one row per task before the shuffle
    (WindowGroupLimit), so a key with very many copies does not pile up.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


BROADCAST_KEYS = 1_000_000  # with their values about 100 MB in memory


def least_per_key(df: DataFrame, keys, column):
    """The rows of each key that hold its least ``column``, nulls first: those that
    ``first_per_key`` with an order by that column first would choose from.

    For stored rows, which are read twice: the least values come from a hash aggregation
    of the narrow columns, and the join with them drops most copies before a wide row is
    sorted or shuffled. Keys and the column may be null. Up to ``BROADCAST_KEYS`` keys are
    broadcast; beyond, Catalyst chooses.
    """
    value = F.col(column)
    # beside the least value whether a null is there; both fit a hash aggregation's buffer
    found = df.groupBy(*keys).agg(F.min(value).alias("_least"), F.max(value.isNull()).alias("_null"))
    least = materialize(found, "least")
    if least.count() <= BROADCAST_KEYS:
        least = F.broadcast(least)
    least = least.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.when(~F.col("_null"), F.col("_least")).alias("_least")
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(least, same & value.eqNullSafe(F.col("_least")), "left_semi")
