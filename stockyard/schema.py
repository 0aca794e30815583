"""Schemas and column lists of the inventory fact and its normalised form."""

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)

# CSV header -> column name -> type, in file order.
CSV_COLUMNS = [
    ("Date", "date", T.DateType()),
    ("Store ID", "store_id", T.StringType()),
    ("Product ID", "product_id", T.StringType()),
    ("Category", "category", T.StringType()),
    ("Region", "region", T.StringType()),
    ("Inventory Level", "inventory_level", T.IntegerType()),
    ("Units Sold", "units_sold", T.IntegerType()),
    ("Units Ordered", "units_ordered", T.IntegerType()),
    ("Demand Forecast", "demand_forecast", MONEY),
    ("Price", "price", MONEY),
    ("Discount", "discount", T.IntegerType()),
    ("Weather Condition", "weather_condition", T.StringType()),
    ("Holiday/Promotion", "holiday_promotion", T.IntegerType()),
    ("Competitor Pricing", "competitor_pricing", MONEY),
    ("Seasonality", "seasonality", T.StringType()),
]

FACT_SCHEMA = T.StructType([T.StructField(name, kind) for _, name, kind in CSV_COLUMNS])
FACT_COLUMNS = FACT_SCHEMA.names
HEADER_OF = {name: header for header, name, _ in CSV_COLUMNS}
KEYS = ["date", "store_id", "product_id"]

NUMERIC_COLUMNS = [f.name for f in FACT_SCHEMA if isinstance(f.dataType, T.NumericType)]
STRING_COLUMNS = [f.name for f in FACT_SCHEMA if isinstance(f.dataType, T.StringType)]

# Physical partition columns of a stored fact: first day of the period of `date`.
GRAINS = {"date_month": "MM", "date_year": "YY"}
MONTH, YEAR = GRAINS

# Lookup table -> (fact column, surrogate id, name column).
LOOKUPS = {
    "categories": ("category", "category_id", "category_name"),
    "regions": ("region", "region_id", "region_name"),
    "weather_conditions": ("weather_condition", "weather_id", "weather_condition"),
    "seasons": ("seasonality", "season_id", "season_name"),
}
# Entity table -> key column.
ENTITIES = {"stores": "store_id", "products": "product_id"}

# The promotion lookup.
PROMOTIONS = [(0, 0, "No Promotion"), (1, 1, "Holiday Promotion")]
PROMOTIONS_SCHEMA = T.StructType(
    [
        T.StructField("promotion_id", T.IntegerType()),
        T.StructField("is_holiday_promotion", T.IntegerType()),
        T.StructField("description", T.StringType()),
    ]
)

# Column order of the normalised fact.
NORMALIZED_COLUMNS = [
    "date", "store_id", "product_id", "category_id", "region_id", "inventory_level",
    "units_sold", "units_ordered", "demand_forecast", "price", "discount",
    "weather_id", "promotion_id", "competitor_pricing", "season_id",
]


def normalized_schema():
    ids = {"category_id", "region_id", "weather_id", "season_id", "promotion_id"}
    return T.StructType(
        [
            T.StructField(c, T.IntegerType()) if c in ids else FACT_SCHEMA[c]
            for c in NORMALIZED_COLUMNS
        ]
    )


def table_schemas():
    """Every table of the flat and the normalised model: name -> StructType."""
    tables = {"inventory_sales": FACT_SCHEMA, "inventory_raw_staging": FACT_SCHEMA}
    for table, key in ENTITIES.items():
        tables[table] = T.StructType([T.StructField(key, T.StringType())])
    for table, (_, key, name) in LOOKUPS.items():
        tables[table] = T.StructType(
            [T.StructField(key, T.IntegerType()), T.StructField(name, T.StringType())]
        )
    tables["promotions"] = PROMOTIONS_SCHEMA
    tables["inventory_sales_normalized"] = normalized_schema()
    return tables
