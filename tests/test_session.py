import datetime
import os
import time
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F

from stockyard import session


def _fake(**conf):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: conf.get(key.replace(".", "_"), default)),
        sparkContext=SimpleNamespace(applicationId="app-1"),
    )


def test_shared_folder_comes_from_the_session():
    fake = _fake(spark_checkpoint_dir="hdfs://x/work", spark_sql_warehouse_dir="/house")
    assert session.shared_dir(fake) == "hdfs://x/work"
    assert session.work_path(fake, "fact").startswith("hdfs://x/work/stockyard/app-1/fact/")


def test_without_it_the_warehouse_is_used():
    assert session.work_path(_fake(spark_sql_warehouse_dir="/house"), "x").startswith("/house/stockyard/")


def test_one_load_per_folder(spark):
    from settings import SF_DIR

    from stockyard.sources import retail_star

    assert retail_star.load(spark, SF_DIR).raw.inputFiles() == retail_star.load(spark, SF_DIR).raw.inputFiles()


def _base_tables(spark, folder):
    """Base tables with missing keys, repeated orders and many copies of a business key."""
    rows = {
        "region": ([(0, "ASIA"), (1, "EUROPE")], "r_regionkey int, r_name string"),
        "nation": ([(0, 0), (1, 1), (2, None)], "n_nationkey int, n_regionkey int"),
        "customer": ([(i, i % 3) for i in range(6)], "c_custkey long, c_nationkey int"),
        "supplier": ([(0, 0), (1, 1), (2, None), (None, 1)], "s_suppkey long, s_nationkey int"),
        "part": (
            [(0, "Brand#11", "PROMO TIN", 9.5), (1, None, "SMALL TIN", 8.0), (2, "Brand#12", None, 7.25)],
            "p_partkey long, p_brand string, p_type string, p_retailprice double",
        ),
        "orders": (
            [(i % 30 if i else None, i % 6, "2-HIGH" if i % 2 else "5-LOW") for i in range(40)],
            "o_orderkey long, o_custkey long, o_orderpriority string",
        ),
        "lineitem": (
            [
                (i * 7 % 31, i % 4, i % 3, i % 4, datetime.date(1995, 1 + i % 2, 3) if i % 9 else None,
                 float(1 + i % 50), 10.5 * i, 0.01 * (i % 11), "A", "F" if i % 3 else None)
                for i in range(400)
            ],
            "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_quantity double, "
            "l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string",
        ),
    }
    for name, (data, kinds) in rows.items():
        spark.createDataFrame(data, kinds).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_stored_fact_is_the_first_row_of_each_key(spark, tmp_path):
    from stockyard import schema as S
    from stockyard.operators import cleaning
    from stockyard.sources import retail_star

    folder = _base_tables(spark, tmp_path)
    inventory = retail_star.load(spark, folder)
    raw = retail_star.raw_rows(spark, folder)
    assert raw.count() > 200 and sorted(inventory.lineage.collect(), key=str) == sorted(raw.collect(), key=str)
    expected = cleaning.clean(raw, tie_break=retail_star.LINEAGE).collect()
    assert sorted(inventory.fact.select(*S.FACT_COLUMNS).collect(), key=str) == sorted(expected, key=str)
    assert any(r.date is None for r in expected) and any(r.product_id is None for r in expected)


def test_the_large_joins_carry_narrow_lines_and_sort_nothing(spark, tmp_path):
    from stockyard.sources import retail_star

    folder = _base_tables(spark, tmp_path)
    with session.settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"), session.unsorted_joins(spark):
        rows = retail_star.raw_rows(spark, folder)
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
    final = plan[:plan.index("== Initial Plan ==")]
    assert "ShuffledHashJoin" in final and "SortMergeJoin" not in final
    order, part = (final.index(f"ShuffledHashJoin [{key}") for key in ("l_orderkey", "l_partkey"))
    assert part < order  # the outer join stands first: texts of parts meet the lines last
    assert spark.conf.get("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold") == "0b"


def test_a_load_writes_its_rows_without_a_shuffle_of_their_own(spark, tmp_path, monkeypatch):
    from stockyard.sources import retail_star

    asked = []
    monkeypatch.setattr(retail_star, "write_partitioned", lambda df, path: path)
    hint = type(spark.range(1)).hint
    monkeypatch.setattr(type(spark.range(1)), "hint", lambda df, *a: (asked.append(a), hint(df, *a))[1])
    retail_star.store(spark, _base_tables(spark, tmp_path))
    assert asked == []


def test_shuffle_files_go_when_their_rows_are_stored(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(blocks.getAllFiles().mkString("\n").split("\n"))
    before = files()
    stored = session.materialize(spark.range(10_000).groupBy((F.col("id") % 977).alias("k")).count(), "cleaned")
    for _ in range(50):  # they are removed in the background
        left = {f for f in files() - before if "shuffle_" in f}
        if not left:
            break
        time.sleep(0.1)
    assert not left and stored.count() == 977


def test_scratch_keeps_only_what_it_is_told_to(spark):
    listed = lambda frame: [os.path.exists(f.removeprefix("file:")) for f in frame.inputFiles()]
    with session.scratch(spark) as outer:
        before = session.materialize(spark.range(3), "a")
        with session.scratch(spark) as keep:
            gone = session.materialize(spark.range(4), "b")
            kept = keep(gone.selectExpr("id + 1 AS id"), "c")
        assert not any(listed(gone)) and all(listed(before)) and all(listed(kept))
        last = outer(kept, "d")
    assert not any(listed(before)) and not any(listed(kept)) and last.count() == 4


def test_batches_of_texts_are_small(spark):
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32())], ["n"]) for b in batches)
    with session.small_batches(spark):
        found = session.materialize(spark.range(6_000).coalesce(1).mapInArrow(sizes, "n int"), "sizes")
    assert found.agg(F.max("n")).first()[0] == 2_500
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
