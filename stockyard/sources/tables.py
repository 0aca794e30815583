"""Stored tables: definition, load with verification, SQL over the catalog.

A load has two phases. The rows are written beside the table and checked there; only then
the table's location is switched to them. A load that fails, or that a check refuses, leaves
the table as it was.
"""

import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard import schema as S
from stockyard.session import work_path

FACT_TABLE = "inventory_sales"


class ShapeError(ValueError):
    pass


class ConstraintError(ValueError):
    pass


def require_unique(df: DataFrame, keys=S.KEYS):
    """Raise if a business key occurs twice: what a primary key would refuse."""
    repeated = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if repeated:
        raise ConstraintError(f"repeated key {repeated[0].asDict()}")
    return df


def require_complete(df: DataFrame, columns=S.FACT_COLUMNS):
    """Number of rows; raises if a column that must be filled has missing values."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    ).first().asDict()
    rows = counts.pop("_rows")
    missing = {c: n for c, n in counts.items() if n}
    if missing:
        raise ConstraintError(f"missing values {missing}")
    return rows


def require_rows(df: DataFrame, rows, name=FACT_TABLE):
    """Raise unless the frame has this many rows."""
    found = df.count()
    if found != rows:
        raise ShapeError(f"{name} would hold {found} rows, expected {rows}")
    return df


def shape_report(df: DataFrame, rows, columns):
    """One row: actual and expected shape. ``rows`` may be a scalar subquery."""
    rows = rows if hasattr(rows, "alias") else F.lit(rows)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        ((F.col("rows") == rows) & F.lit(len(df.columns) == columns)).alias("ok"),
    )


def check_input_shape(df: DataFrame, rows, columns):
    """Raise unless the frame has exactly this many rows and columns."""
    found = (df.count(), len(df.columns))
    if found != (rows, columns):
        raise ShapeError(f"unexpected shape {found}, expected {(rows, columns)}")
    return df


# Tables that are stored by month of ``date``.
FACTS = {FACT_TABLE, "inventory_sales_normalized"}

# Properties of a table: the folder of its versions, and the version before the current one.
ROOT, PREVIOUS = "stockyard.root", "stockyard.previous"


@contextmanager
def _listed_partitions(spark):
    """Tables created inside find their partitions by listing their location, not in the
    catalog, so one change of location changes all of their content."""
    key = "spark.sql.hive.manageFilesourcePartitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def create_tables(spark, names=None, prefix="", location=None, grain=S.MONTH, keep=False):
    """Create typed Parquet tables, empty and anew. Returns name -> catalog name.

    With ``keep`` a table that exists stays as it is, with its rows and its place. Each
    table has a folder of its full name under ``location`` (by default the shared work
    folder), with a folder for each load. Fact tables are partitioned by ``grain``, the first
    day of the month (or year) of the date, which is one more column at their end.
    """
    location = location or work_path(spark, "tables")
    created = {}
    for name, schema in S.table_schemas().items():
        if names is not None and name not in names:
            continue
        created[name] = table = f"{prefix}{name}"
        if keep and spark.catalog.tableExists(table):
            continue
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        stored = f"{columns}, `{grain}` date) USING parquet PARTITIONED BY (`{grain}`" if name in FACTS else f"{columns}) USING parquet"
        closing = ")" if name in FACTS else ""
        root = f"{location}/{table}"
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        with _listed_partitions(spark):
            spark.sql(
                f"CREATE TABLE {table} ({stored}{closing} LOCATION '{root}/{uuid.uuid4().hex}' "
                f"TBLPROPERTIES ('{ROOT}' = '{root}')"
            )
    return created


def arranged(df: DataFrame, grain=S.MONTH):
    """Fact rows as they are stored: with their period, files of even size, by date.

    REBALANCE lets adaptive execution split a period that holds much of the data and
    merge small ones, so neither tiny files nor one huge task results.
    """
    return (
        df.withColumn(grain, F.trunc("date", S.GRAINS[grain]))
        .hint("rebalance", grain)
        .sortWithinPartitions(grain, "date")
    )


@dataclass
class Staged:
    """A version of a table's content that is written, but not yet what the table shows."""

    table: str
    path: str
    rows: DataFrame


def _property(spark, table, key):
    found = spark.sql(f"SHOW TBLPROPERTIES {table}").filter(F.col("key") == key).collect()
    return found[0]["value"] if found else None


def _location(spark, table):
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}")
    return described.filter("col_name = 'Location'").collect()[-1]["data_type"]


def stage(df: DataFrame, table):
    """First phase of a load: write the rows, with the table's types and layout, to a
    folder of their own. The table and its readers see nothing of it."""
    spark = df.sparkSession
    schema = spark.table(table).schema
    grains = [g for g in S.GRAINS if g in schema.names]
    path = f"{_property(spark, table, ROOT) or work_path(spark, table)}/{uuid.uuid4().hex}"
    rows = df.select(*[F.col(f.name).cast(f.dataType) for f in schema if f.name not in grains])
    writer = arranged(rows, grains[0]).write.partitionBy(grains[0]) if grains else rows.write
    writer.parquet(path)
    return Staged(table, path, spark.read.schema(schema).parquet(path))


def switch(spark, *staged):
    """Second phase: the tables show what was staged, in the given order.

    Each table changes by one entry of the catalog, whatever the session's overwrite mode.
    The version before stays, for ``restore`` and for frames that still read it.
    """
    for version in staged:
        spark.sql(
            f"ALTER TABLE {version.table} SET TBLPROPERTIES ('{PREVIOUS}' = '{_location(spark, version.table)}')"
        )
        spark.sql(f"ALTER TABLE {version.table} SET LOCATION '{version.path}'")
        spark.catalog.refreshTable(version.table)


def restore(spark, table):
    """Back to the version before the last load (and forth, if called again)."""
    path = _property(spark, table, PREVIOUS)
    if path is None:
        raise ValueError(f"{table} has no version before")
    switch(spark, Staged(table, path, None))


def drop_older(spark, table):
    """Delete the folders of versions that are neither the current one nor the one before.

    Returns how many there were. For a time when no load of the table is running.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(_property(spark, table, ROOT))
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    kept = {p.rstrip("/").rsplit("/", 1)[1] for p in (_location(spark, table), _property(spark, table, PREVIOUS)) if p}
    older = [f.getPath() for f in files.listStatus(root) if f.isDirectory() and f.getPath().getName() not in kept]
    for path in older:
        files.delete(path, True)
    return len(older)


def insert_select(df: DataFrame, table, checks=()):
    """Replace the rows of a table by those of the frame; loading twice changes nothing.

    ``checks`` get the written rows and raise if they refuse them; then the table keeps
    what it had.
    """
    version = stage(df, table)
    for check in checks:
        check(version.rows)
    switch(df.sparkSession, version)


def insert_values(spark, rows, table):
    """Literal rows as the content of a lookup table."""
    insert_select(spark.createDataFrame(rows, spark.table(table).schema), table)


def load_fact(df: DataFrame, table=FACT_TABLE, expected_rows=None, checks=()):
    """Replace the fact table's rows, if the written ones pass: their number, no missing
    values, no repeated key, and any other ``checks``. Returns the number of rows."""
    count = []

    def complete(written):
        count.append(require_complete(written))
        if expected_rows is not None and count[0] != expected_rows:
            raise ShapeError(f"{table} would hold {count[0]} rows, expected {expected_rows}")

    insert_select(df.select(*S.FACT_COLUMNS), table, [complete, require_unique, *checks])
    return count[0]


def write_partitioned(df: DataFrame, path, grain=S.MONTH):
    """Store fact rows under a path, arranged as in a fact table."""
    arranged(df, grain).write.partitionBy(grain).mode("overwrite").parquet(path)
    return path


def read_partitioned(spark, path, grain=S.MONTH):
    stored = T.StructType([*S.FACT_SCHEMA.fields, T.StructField(grain, T.DateType())])
    return spark.read.schema(stored).parquet(path)


def register_views(**frames):
    """Make frames available to SQL text under the given names."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


def table_query(spark, sql, **frames):
    """Run SQL text; ``frames`` become its tables (by name, without global views)."""
    return spark.sql(sql, **frames) if frames else spark.sql(sql)
