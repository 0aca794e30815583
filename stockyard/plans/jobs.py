"""The four end-to-end jobs: clean a file, load it flat or normalised, publish orders."""

from pyspark.sql import functions as F

from stockyard import schema as S
from stockyard.operators import cleaning, quality, replenishment, star
from stockyard.session import materialize
from stockyard.sources import files, tables


def clean_csv(spark, source, target):
    """Profile and clean a raw CSV; writes the clean CSV, returns the quality summary.

    Dates that do not parse become missing and show in the summary.
    """
    raw = cleaning.parse_dates(files.read_csv(spark, source, text_dates=True), strict=False)
    rows = materialize(cleaning.clip_negative_forecast(raw), "clean")
    files.write_csv(rows, target)
    return quality.quality_summary(rows)


def load_flat(spark, source, prefix="", expected_shape=None, location=None):
    """Clean CSV into the typed flat table ``<prefix>inventory_sales``, by month.

    The rows are written beside the table and checked there: another shape, missing values
    and repeated keys are refused, and the table keeps what it had.
    """
    rows = files.read_csv(spark, source)
    count, columns = expected_shape or (None, len(rows.columns))
    if len(rows.columns) != columns:
        raise tables.ShapeError(f"unexpected columns {len(rows.columns)}, expected {columns}")
    created = tables.create_tables(spark, [tables.FACT_TABLE], prefix, location, keep=True)
    name = created[tables.FACT_TABLE]
    tables.load_fact(rows, name, expected_rows=count)
    return spark.table(name)


def load_star(spark, source, prefix="", location=None, allow_refused=False):
    """Raw delimited file into staging, clip, dimensions, normalised fact, checks.

    Returns (tables by name, reconciliation report). The report compares the staging
    with the fact, refused lines included. Lines the parser refuses stop the load,
    unless ``allow_refused``: then they are left out, and the report says how many.
    Missing values and repeated keys in the others stop it in any case.
    """
    staged = files.bulk_load(spark, source)
    refused = staged.filter(F.col(files.CORRUPT).isNotNull()).count()
    if refused and not allow_refused:
        raise tables.ConstraintError(f"{refused} refused lines")
    rows = cleaning.clip_negative_forecast(
        staged.filter(F.col(files.CORRUPT).isNull()).select(*S.FACT_COLUMNS)
    )
    tables.require_complete(rows)
    stored = store_star(rows, prefix, location)
    return stored, star.load_reconciliation(staged, stored["inventory_sales_normalized"])


def store_star(rows, prefix="", location=None, anew=False):
    """Fill every table of the normalised model; returns name -> frame.

    Loading again replaces the fact, and the dimensions grow: a name that is stored keeps
    its id. ``anew`` forgets what is stored. All tables are written beside the stored ones;
    rows, keys and references of the fact are checked there; then the dimensions are
    switched, and the fact last. A load that is refused changes no table.
    """
    spark = rows.sparkSession
    fact = "inventory_sales_normalized"
    dimension_names = [*S.ENTITIES, *S.LOOKUPS]
    names = [*dimension_names, "promotions"]
    catalog = tables.create_tables(spark, [*names, fact], prefix, location, keep=not anew)
    merged = star.merge_dimensions(rows, {name: spark.table(catalog[name]) for name in dimension_names})
    staged = {name: tables.stage(merged[name], catalog[name]) for name in names}
    beside = {name: version.rows for name, version in staged.items()}
    staged[fact] = tables.stage(star.normalize(rows, beside), catalog[fact])
    written = staged[fact].rows
    tables.require_rows(written, rows.count())
    tables.require_unique(written)
    orphans = star.star_schema_check(written, beside).filter("orphan_rows > 0").collect()
    if orphans:
        raise tables.ConstraintError(f"references without a target {[o.asDict() for o in orphans]}")
    tables.switch(spark, *staged.values())
    return {name: spark.table(catalog[name]) for name in [*names, fact]}


def publish_reorder(fact, target, as_of=None, gated=False):
    """The reorder table of a date as CSV with the report's columns."""
    rounding = "half_up" if gated else "half_even"
    table = replenishment.reorder(fact, as_of, gated=gated, rounding=rounding)
    return files.write_csv(table.drop("region"), target)
