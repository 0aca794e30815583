"""Delimited files in and out."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard import schema as S
from stockyard.functions import dates as D
from stockyard.session import materialize

CORRUPT = "_corrupt_record"


def _header_schema(text_dates, corrupt=False):
    fields = [
        T.StructField(header, T.StringType() if text_dates and name == "date" else kind)
        for header, name, kind in S.CSV_COLUMNS
    ]
    if corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType()))
    return T.StructType(fields)


def _renamed(df):
    names = [name for _, name, _ in S.CSV_COLUMNS]
    return df.select(*[F.col(f"`{S.HEADER_OF[n]}`").alias(n) for n in names])


def read_csv(spark, path, date_format=D.ISO, text_dates=False):
    """CSV with the titled header, typed by a fixed schema, snake_case columns.

    ``enforceSchema`` is off: a file whose header does not match is refused.
    ``text_dates`` keeps the date as text for a later strict or lenient parse.
    """
    return _renamed(
        spark.read.schema(_header_schema(text_dates))
        .option("header", True)
        .option("enforceSchema", False)
        .option("dateFormat", date_format)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def bulk_load(spark, path, sep=",", quote='"', mode="PERMISSIVE", date_format=D.ISO):
    """Load a delimited file into staging: header skipped, columns by position.

    Bad rows stay, with their text in one more column. The staging is stored with all
    columns, because the parser only notices a bad field in a column it is asked for.
    """
    fields = [*S.FACT_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())]
    parsed = (
        spark.read.schema(T.StructType(fields))
        .option("header", True)
        .option("sep", sep)
        .option("quote", quote)
        .option("mode", mode)
        .option("dateFormat", date_format)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )
    return materialize(parsed, "csv_staging")


def write_csv(df: DataFrame, path, titled=True, mode="overwrite"):
    """Header, no index, ISO dates. ``titled`` restores the original headers."""
    if titled:
        df = df.select(*[F.col(c).alias(S.HEADER_OF.get(c, c)) for c in df.columns])
    df.write.mode(mode).option("header", True).option("dateFormat", D.ISO).csv(path)
    return path
