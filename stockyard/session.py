"""Session settings and the shared work folder."""

import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master=None, app_name="stockyard", **conf):
    """A session with adaptive execution on. Cluster settings win over these."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",  # an overflow raises
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark):
    """Folder that driver and executors share: the one the cluster names in
    ``spark.checkpoint.dir``, else the warehouse folder, which every session has."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def work_path(spark, label):
    """A new path under the shared folder; never used twice."""
    root = shared_dir(spark).rstrip("/")
    return "/".join([root, "stockyard", spark.sparkContext.applicationId, label, uuid.uuid4().hex])


_open = threading.local()  # the paths that belong to the scratch blocks around a call


@contextmanager
def scratch(spark):
    """What is materialized inside is deleted at the end, but for what the function that
    the block gets has stored. No frame that reads the rest may be used after it."""
    outer, paths = getattr(_open, "paths", None), []
    _open.paths = paths

    def keep(df, label):
        _open.paths = outer
        try:
            return materialize(df, label)
        finally:
            _open.paths = paths

    try:
        yield keep
    finally:
        _open.paths = outer
        for path in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def materialize(df: DataFrame, label):
    """Write ``df`` once and read it back.

    The stored files survive the loss of executors, cut the lineage, and give
    Catalyst a real size, which is what its broadcast threshold is checked against.
    The shuffle files of the write go with its end, not when the driver next happens
    to collect its garbage, so disk follows the largest step and not their sum.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark, **values):
    """Session settings (``__`` in a name for its dots) for the queries that run inside."""
    values = {key.replace("__", "."): value for key, value in values.items()}
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def unsorted_joins(spark):
    """Inside, adaptive execution joins by a hash table instead of a sort wherever one side's
    partitions turn out small enough, so wide rows on the other side are never sorted or
    spilled. Larger partitions are sorted as always."""
    return settings(spark, spark__sql__adaptive__maxShuffledHashJoinLocalMapThreshold="64m")


def small_batches(spark):
    """Inside, Python workers get 2,500 rows at a time, not 10,000: of whole texts a batch is
    held by the executor and by the worker at once."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="2500")
