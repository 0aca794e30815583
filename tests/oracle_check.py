"""Run named queries against their SQL oracle and compare schema and values."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def duck(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return f"dec:{value.normalize():f}"
    return repr(value)


def _rows(names, rows, ordered):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return cells if ordered else sorted(cells)


KINDS = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "smallint": "SMALLINT", "tinyint": "TINYINT",
}


def _kind(spark_type):
    name = spark_type.simpleString()
    return KINDS.get(name, name.upper())


def compare(df, con, sql, ordered=False):
    """None if equal (with ``ordered``, row by row), else the first difference as text."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    types = {d[0]: str(d[1]).replace(" ", "") for d in result.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    for field in df.schema:
        kind = _kind(field.dataType)
        declared = types[field.name]
        if declared in ("NUMBER", "STRING", "bool", "Date"):
            continue
        if kind != declared:
            return f"type of {field.name}: {kind} vs {declared}"
    actual = df.collect()
    if len(actual) != len(expected):
        return f"{len(actual)} rows vs {len(expected)}"
    left, right = _rows(df.columns, actual, ordered), _rows(names, expected, ordered)
    for a, b in zip(left, right):
        if a != b:
            return f"first difference {a} vs {b}"
    return None
