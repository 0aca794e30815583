"""The daily inventory fact derived from an order / part / supplier star schema."""

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard import schema as S
from stockyard.operators.cleaning import clean
from stockyard.operators.ordering import least_per_key
from stockyard.session import unsorted_joins, work_path
from stockyard.sources.tables import read_partitioned, write_partitioned

BASE_TABLES = ["lineitem", "orders", "customer", "nation", "region", "supplier", "part"]
# Columns that order the copies of a business key; kept in the staging table.
LINEAGE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ext", "qty"]

_lock = threading.Lock()
_stored = {}


@dataclass
class Inventory:
    raw: DataFrame      # staging rows: negative forecasts, repeated keys
    lineage: DataFrame  # raw plus the columns that order copies of a key
    fact: DataFrame     # one clean row per key


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _code(letter, text, width):
    """Letter and text with zeros before it; longer text stays whole."""
    return F.concat(F.lit(letter), F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0")))


def raw_rows(spark, folder):
    """Order lines as store x product observations.

    The order side is reduced to (order, priority, region) and the lines to the numbers
    that the rows are made of before they meet, so the one large shuffle carries narrow
    rows; the texts of parts join after it. No hints: Catalyst broadcasts what its size
    statistics allow, and adaptive execution splits skewed join keys.
    """
    orders = (
        _table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        .join(
            _table(spark, folder, "customer").select("c_custkey", "c_nationkey")
            .join(
                _table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
                .join(
                    _table(spark, folder, "region").select("r_regionkey", "r_name"),
                    F.col("n_regionkey") == F.col("r_regionkey"),
                ),
                F.col("c_nationkey") == F.col("n_nationkey"),
            ),
            F.col("o_custkey") == F.col("c_custkey"),
        )
        .select(
            "o_orderkey",
            F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("holiday_promotion"),
            F.col("r_name").alias("region"),
        )
    )
    supplier = _table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    part = _table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    lines = (
        _table(spark, folder, "lineitem")
        .select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.col("l_shipdate").cast("date").alias("date"),
            F.col("l_quantity").cast("int").alias("qty"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("ext"),
            F.round(F.col("l_discount") * 100).cast("int").alias("discount"),
            F.concat("l_returnflag", "l_linestatus").alias("_weather"),
        )
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )

    date, quantity, weather = F.col("date"), F.col("qty"), F.col("_weather")
    order, line, item, source = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    level = ((order * 37 + item * 17 + line * 5) % 451 + 50).cast("int")
    noise = ((order * 13 + line * 101 + source * 7) % 3001 - 1000).cast("decimal(10,2)") * F.lit(
        "0.01"
    ).cast("decimal(3,2)")
    sold = F.floor(level * (quantity - 1) / 50).cast("int")
    price = F.col("p_retailprice").cast("decimal(10,2)")
    # How line flags and months stand for weather and season.
    weather_name = (
        F.when(weather == "AF", "Cloudy").when(weather == "AO", "Rainy")
        .when(weather == "NF", "Snowy").otherwise("Sunny")
    )
    month = F.month(date)
    season = (
        F.when(month.isin(3, 4, 5), "Spring").when(month.isin(6, 7, 8), "Summer")
        .when(month.isin(9, 10, 11), "Autumn").otherwise("Winter")
    )
    return lines.select(
        "date",
        _code("S", (F.col("s_nationkey") + 1).cast("string"), 3).alias("store_id"),
        _code("P", F.replace("p_brand", F.lit("Brand#"), F.lit("")), 4).alias("product_id"),
        F.col("p_type").alias("category"),
        "region",
        level.alias("inventory_level"),
        sold.alias("units_sold"),
        ((item * 11 + order * 3) % 181 + 20).cast("int").alias("units_ordered"),
        (sold.cast("decimal(10,2)") + noise).cast("decimal(10,2)").alias("demand_forecast"),
        price.alias("price"),
        "discount",
        weather_name.alias("weather_condition"),
        "holiday_promotion",
        (price + noise).cast("decimal(10,2)").alias("competitor_pricing"),
        season.alias("seasonality"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "ext",
        "qty",
    )


def load(spark, folder) -> Inventory:
    """Staging and fact of a folder of base tables.

    Both are stored once per application and folder under the shared folder, the fact
    by month as any fact table, and read again with pruned columns and pushed filters.
    The base tables are taken as fixed while the application runs; ``store`` loads anew.
    """
    with _lock:
        key = (spark.sparkContext.applicationId, folder)
        if key not in _stored:
            _stored[key] = store(spark, folder)
        lineage_path, schema, fact_path = _stored[key]
    lineage = spark.read.schema(schema).parquet(lineage_path)
    return Inventory(lineage.select(*S.FACT_COLUMNS), lineage, read_partitioned(spark, fact_path))


def store(spark, folder):
    """Write staging and fact; returns the paths and the schema of the staging rows."""
    lineage_path = work_path(spark, "staging")
    with unsorted_joins(spark):
        lineage = raw_rows(spark, folder)
        lineage.write.parquet(lineage_path)  # in the partitions of its last join: no shuffle more
        lineage = spark.read.schema(lineage.schema).parquet(lineage_path)
        rows = least_per_key(lineage, S.KEYS, LINEAGE[0])
        fact_path = write_partitioned(clean(rows, tie_break=LINEAGE), work_path(spark, "fact"))
    return lineage_path, lineage.schema, fact_path
