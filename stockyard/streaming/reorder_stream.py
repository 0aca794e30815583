"""The daily reorder check as a stream over newly arriving fact files.

The stream keeps one row of state per business key, the version that arrived last, by a
JVM-side aggregation in update mode; with a watermark, keys that are older than it leave the
state. A micro-batch hands on the keys it changed, and their dates' order lists are written
anew under the batch's number, from the lists before and the changed keys. A key that was
on the list and triggers no more stays in it as withdrawn, so a list never vanishes. The
reader takes the newest list of each date, nothing else; older lists are only history.
Replaying a batch ignores what it wrote before and replaces it, so it changes nothing.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from stockyard import params as P
from stockyard import schema as S
from stockyard.operators.cleaning import clip_negative_forecast
from stockyard.operators.replenishment import REORDER_COLUMNS, with_reorder
from stockyard.session import settings

BATCH, DATE = "batch_id", "list_date"
OUTPUT = ["date", *[c for c in REORDER_COLUMNS if c != "reorder_trigger"]]
ARRIVAL = "_arrival"
SPLIT = "16m"  # of stored fact rows, about a million
ACCOUNT = "batch_id long, arrived long, kept long, late long, repeated long, watermark string"


def read_fact_stream(spark, path, files_per_batch=None):
    """Parquet files as they arrive, with the fixed fact schema.

    ``_arrival`` orders the versions of a key: the time of the file, its name, the row's
    place in it. The name is the path without the start that all files share, as each row
    carries it through the sort and into the state.
    """
    reader = spark.readStream.schema(S.FACT_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    file, root = F.col("_metadata.file_path"), F.lit(path.rstrip("/"))
    at = F.locate(path.rstrip("/"), file)  # the first place: the same one in the paths of all files
    name = F.when(at > 0, F.substring(file, at + F.length(root), F.length(file))).otherwise(file)
    order = ["_metadata.file_modification_time", name.alias("file_path"), "_metadata.row_index"]
    return reader.parquet(path).select("*", F.struct(*order).alias(ARRIVAL))


def newest_versions(stream: DataFrame, watermark=None):
    """The version of each key that arrived last, cleaned; for update mode.

    ``stream`` has the fact's columns and an orderable ``_arrival``. ``watermark`` (such as
    "7 days") bounds the state: rows of dates that lie further behind the newest date are
    late and dropped by the state store. Without it the state holds every key.
    """
    rows = clip_negative_forecast(stream).withColumn("_event_time", F.col("date").cast("timestamp"))
    if watermark:
        rows = rows.withWatermark("_event_time", watermark)
    others = [c for c in S.FACT_COLUMNS if c not in S.KEYS]
    return (
        rows.groupBy("_event_time", "store_id", "product_id")
        .agg(F.max_by(F.struct(*others), F.col(ARRIVAL)).alias("_newest"))
        .select(F.col("_event_time").cast("date").alias("date"), "store_id", "product_id", "_newest.*")
        .select(*S.FACT_COLUMNS)
    )


def _lists(spark, output):
    """All lists ever written, or None."""
    try:
        return spark.read.parquet(output)
    except AnalysisException:  # nothing is written yet
        return None


def _newest_lists(lists):
    """The list of each date that the last batch wrote.

    Which batch that is follows from the folders: the subquery reads no column of the
    files, and its result, an entry for each date, prunes all folders but the newest.
    """
    newest = lists.groupBy(DATE).agg(F.struct(DATE, F.max(BATCH).alias(BATCH)).alias("_list"))
    return lists.filter(F.array_contains(newest.agg(F.collect_list("_list")).scalar(), F.struct(DATE, BATCH)))


def start(stream: DataFrame, output, checkpoint, buffer=P.BUFFER, watermark=None, available_now=True):
    """Start the query; ``available_now`` processes what is there and stops."""

    def write_batch(batch, batch_id):
        spark = batch.sparkSession
        changed = with_reorder(batch, buffer).select(*OUTPUT, "reorder_trigger").persist()
        try:
            dates = [r["date"] for r in changed.select("date").distinct().collect()]
            if not dates:
                return
            rows, lists = changed, _lists(spark, output)
            if lists is not None:
                lists = lists.filter((F.col(BATCH) < batch_id) & F.col(DATE).isin(dates))
                before = _newest_lists(lists).select(*OUTPUT, "reorder_trigger")
                listed = before.select(*S.KEYS, F.lit(True).alias("_listed"))
                kept = before.join(changed.select(*S.KEYS), S.KEYS, "left_anti")
                # what was never on a list and triggers nothing needs no row
                rows = changed.join(listed, S.KEYS, "left").filter("reorder_trigger OR _listed")
                rows = rows.drop("_listed").unionByName(kept)
            else:
                rows = rows.filter("reorder_trigger")
            rows.withColumn(DATE, F.col("date")).write.partitionBy(DATE).mode("overwrite").parquet(
                f"{output}/{BATCH}={batch_id}"
            )
        finally:
            changed.unpersist()

    writer = (
        newest_versions(stream.observe("arrivals", F.count(F.lit(1)).alias("arrived")), watermark)
        .writeStream.outputMode("update").foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run(stream: DataFrame, output, checkpoint, **options):
    """Process what is there and return the finished query; fails as it fails.

    The state's aggregation sorts the rows of each task by key. Splits of the default size
    hold millions of wide rows and spill, so files are read in smaller ones meanwhile.
    """
    with settings(stream.sparkSession, spark__sql__files__maxPartitionBytes=SPLIT):
        query = start(stream, output, checkpoint, **options)
        query.awaitTermination()
    return query


def read_orders(spark, output, dates=None, withdrawn=False):
    """The current order lists, of all dates or of the given ones, with a row for each key
    whose newest version triggers; ``withdrawn`` shows the keys that no longer do instead."""
    lists = _lists(spark, output)
    if lists is None:
        kinds = ", ".join(f"{c} {_kind(c)}" for c in OUTPUT)
        return spark.createDataFrame([], kinds)
    if dates is not None:
        lists = lists.filter(F.col(DATE).isin(list(dates)))
    state = ~F.col("reorder_trigger") if withdrawn else F.col("reorder_trigger")
    return _newest_lists(lists).filter(state).select(*OUTPUT)


def _kind(column):
    if column == "recommended_order_qty":
        return "bigint"
    return S.FACT_SCHEMA[column].dataType.simpleString() if column in S.FACT_COLUMNS else "string"


def account(spark, query):
    """What became of the rows of each batch of a query, from its progress reports.

    ``arrived`` are rows; ``kept`` are keys whose state a batch changed; ``late`` are keys whose
    rows came after the watermark, which the state store dropped; ``repeated`` is what else
    arrived: further versions of a key within the batch. Batches without rows are left out,
    and Spark reports the last ``spark.sql.streaming.numRecentProgressUpdates`` batches.
    """
    rows = []
    for progress in query.recentProgress:
        arrived = progress["observedMetrics"].get("arrivals")
        arrived = arrived["arrived"] if arrived else 0
        if not arrived:
            continue
        state = progress["stateOperators"][0]
        kept, late = state["numRowsUpdated"], state["numRowsDroppedByWatermark"]
        watermark = progress["eventTime"].get("watermark")
        rows.append((progress["batchId"], arrived, kept, late, arrived - kept - late, watermark))
    return spark.createDataFrame(rows, ACCOUNT)

