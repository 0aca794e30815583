"""Normalised model: entity and lookup tables, surrogate keys, fact, checks."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard import schema as S
from stockyard.functions import measures as M
from stockyard.operators.ordering import accumulate, group_offsets, place
from stockyard.operators.quality import foreign_key_check, to_long
from stockyard.session import materialize


def names(df: DataFrame):
    """(table, value): every distinct value of the entity keys and of the names that have
    a lookup, from one scan of the rows. Missing values are left out."""
    columns = {**S.ENTITIES, **{table: column for table, (column, _, _) in S.LOOKUPS.items()}}
    keys = list(columns.values())
    # Each set keeps one column and leaves the others null: its bit alone is 0 in the id.
    sets = df.groupingSets([[c] for c in keys], *keys).agg(F.grouping_id().alias("_set"))
    every = 2 ** len(keys) - 1
    ids = {every - 2 ** (len(keys) - 1 - i): table for i, table in enumerate(columns)}
    name = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])[F.col("_set").cast("int")]
    return sets.select(name.alias("table"), F.coalesce(*keys).alias("value")).filter(F.col("value").isNotNull())


def build_dimensions(df: DataFrame):
    """Name -> frame for the two entity tables, four lookups and the promotions.

    Surrogate ids follow the name order within a lookup, so a rerun gives the same ids.
    """
    return merge_dimensions(df, {})


def merge_dimensions(df: DataFrame, stored):
    """The stored dimensions (name -> frame; those that are absent count as empty) and what
    the rows add to them.

    A stored name keeps its id for good, also if no row has it any more. New names get ids
    after the largest of their lookup, in name order, from a distributed rank, so a lookup may
    be of any size. The names are found in one scan of the rows and stored, and so are the
    lookups: joins with them read a file of a known size.
    """
    found = materialize(names(df), "names")
    parts = [
        stored[table].select(F.lit(table).alias("table"), F.col(name).alias("value"), F.col(key).alias("id"))
        for table, (_, key, name) in S.LOOKUPS.items() if table in stored
    ]
    fresh = found.filter(F.col("table").isin(list(S.LOOKUPS)))
    known = reduce(DataFrame.unionAll, parts) if parts else None
    if known is not None:
        fresh = fresh.join(known, ["table", "value"], "left_anti")
    placed = place(fresh, ["table", "value"])
    # Four rows each; a join by shuffle would put a whole lookup in one task.
    starts = F.broadcast(group_offsets(placed, "table"))
    number = (F.col("_rank") - F.col("_base")).cast("int")
    numbered = accumulate(placed, into="_rank").join(starts, "table")
    if known is not None:
        last = known.groupBy("table").agg(F.max("id").alias("_last"))
        numbered = numbered.join(F.broadcast(last), "table", "left")
        number += F.coalesce("_last", F.lit(0))
    numbered = numbered.select("table", "value", number.alias("id"))
    lookups = materialize(known.unionAll(numbered) if known is not None else numbered, "lookups")
    dimensions = {}
    for table, key in S.ENTITIES.items():
        members = found.filter(F.col("table") == table).select(F.col("value").alias(key))
        if table in stored:
            members = stored[table].select(key).unionAll(members.join(stored[table], key, "left_anti"))
        dimensions[table] = members
    for table, (_, key, name) in S.LOOKUPS.items():
        dimensions[table] = lookups.filter(F.col("table") == table).select(
            F.col("id").alias(key), F.col("value").alias(name)
        )
    dimensions["promotions"] = df.sparkSession.createDataFrame(S.PROMOTIONS, S.PROMOTIONS_SCHEMA)
    return dimensions


def normalize(df: DataFrame, dimensions):
    """Replace the four names by surrogate ids (inner lookups) and rename the flag.

    The dimensions come from stored files, so Catalyst knows their size: below its
    broadcast threshold the fact is not shuffled, above it the join is sort-merge
    with adaptive skew handling.
    """
    fact = df.withColumn("promotion_id", F.col("holiday_promotion"))
    for table, (column, key, name) in S.LOOKUPS.items():
        lookup = dimensions[table].select(F.col(name).alias(column), key)
        fact = fact.join(lookup, column)
    return fact.select(*S.NORMALIZED_COLUMNS)


def denormalize(fact: DataFrame, dimensions):
    """The flat 15-column fact back from the normalised one."""
    flat = fact.withColumnRenamed("promotion_id", "holiday_promotion")
    for table, (column, key, name) in S.LOOKUPS.items():
        lookup = dimensions[table].select(key, F.col(name).alias(column))
        flat = flat.join(lookup, key)
    return flat.select(*S.FACT_COLUMNS)


def star_schema_check(fact: DataFrame, dimensions):
    """Orphans per foreign key of the normalised fact."""
    keys = {
        "store_id": (dimensions["stores"], "store_id"),
        "product_id": (dimensions["products"], "product_id"),
        "promotion_id": (dimensions["promotions"], "promotion_id"),
    }
    for table, (_, key, _) in S.LOOKUPS.items():
        keys[key] = (dimensions[table], key)
    return foreign_key_check(fact, keys)


def staging_check(staging: DataFrame, dimensions):
    """As ``star_schema_check``, for flat rows that were not looked up yet: rows whose
    name a lookup lacks, which normalising would lose, show as orphans of its key."""
    rows = staging.withColumn("promotion_id", F.col("holiday_promotion"))
    keys = {
        "store_id": (dimensions["stores"], "store_id"),
        "product_id": (dimensions["products"], "product_id"),
        "promotion_id": (dimensions["promotions"], "promotion_id"),
    }
    for table, (column, key, name) in S.LOOKUPS.items():
        rows = rows.withColumn(key, F.col(column))
        keys[key] = (dimensions[table], name)
    return foreign_key_check(rows, keys)


def load_reconciliation(staging: DataFrame, fact: DataFrame, refused="_corrupt_record"):
    """(check, expected, actual, ok): a load must not lose rows or values.

    If the staging has the parser's column of refused lines, they are counted too.
    """
    before = staging.agg(
        M.rows().alias("rows"), F.count_distinct("category").alias("categories"),
        (F.count(refused) if refused in staging.columns else F.lit(0)).cast("bigint").alias("refused"),
    )
    after = fact.agg(M.rows().alias("rows"), F.count_distinct("category_id").alias("categories")).withColumn(
        "refused", F.lit(0).cast("bigint")
    )
    checks = ["rows", "categories"] + ["refused"] * (refused in staging.columns)
    # the staging is expected to hold no refused line, the fact all of its rows
    expected = to_long(before.select(*checks), checks, "check", "expected")
    actual = to_long(after.select(*checks), checks, "check", "actual")
    if "refused" in checks:
        swap = F.col("check") == "refused"
        joined = expected.join(actual, "check").select(
            "check", F.when(swap, F.col("actual")).otherwise(F.col("expected")).alias("expected"),
            F.when(swap, F.col("expected")).otherwise(F.col("actual")).alias("actual"),
        )
    else:
        joined = expected.join(actual, "check")
    return joined.withColumn("ok", F.col("expected") == F.col("actual"))


def row_counts(tables):
    """(table_name, row_count) over named frames."""
    counts = [
        frame.agg(M.rows().alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, frame in tables.items()
    ]
    return reduce(DataFrame.unionAll, counts)
