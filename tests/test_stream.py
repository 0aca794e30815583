"""Orders of the stream: newest versions, late rows, replays."""

import pytest
from pyspark.sql import functions as F

from stockyard.streaming import reorder_stream

SHORT = {"inventory_level": 10, "demand_forecast": 50}
FULL = {"inventory_level": 900, "demand_forecast": 50}


@pytest.fixture
def arrivals(spark, facts, tmp_path):
    """A function that lets rows arrive in one file, runs the stream and returns the run."""

    class Stream:
        source, output, state = (str(tmp_path / d) for d in ("in", "out", "state"))

        def arrive(self, *rows, **options):
            if rows:
                facts(*rows).coalesce(1).write.mode("append").parquet(self.source)
            stream = reorder_stream.read_fact_stream(spark, self.source)
            run = reorder_stream.start(stream, self.output, self.state, **options)
            run.awaitTermination()
            return run

        def orders(self, **options):
            found = reorder_stream.read_orders(spark, self.output, **options).collect()
            return sorted((r.store_id, r.recommended_order_qty) for r in found)

    return Stream()


@pytest.mark.parametrize("watermark", [None, "7 days"])
def test_several_arrivals(arrivals, watermark):
    arrivals.arrive({**SHORT, "store_id": "a"}, {"store_id": "b"}, {**SHORT, "store_id": "n", "demand_forecast": -4}, watermark=watermark)
    # The same day again: one repeated key, one new row.
    arrivals.arrive({**SHORT, "store_id": "a"}, {**SHORT, "store_id": "c"}, watermark=watermark)
    arrivals.arrive(watermark=watermark)
    assert arrivals.orders() == [("a", 45), ("c", 45)] and arrivals.orders(withdrawn=True) == []


@pytest.mark.parametrize("watermark", [None, "7 days"])
def test_a_later_delivery_withdraws_an_order(arrivals, watermark):
    arrivals.arrive({**SHORT, "store_id": "a"}, {**SHORT, "store_id": "b"}, watermark=watermark)
    arrivals.arrive({**FULL, "store_id": "a"}, watermark=watermark)
    assert arrivals.orders() == [("b", 45)] and arrivals.orders(withdrawn=True) == [("a", 0)]
    arrivals.arrive({**SHORT, "store_id": "a", "inventory_level": 40}, watermark=watermark)
    assert arrivals.orders() == [("a", 15), ("b", 45)] and arrivals.orders(withdrawn=True) == []


@pytest.mark.parametrize("watermark", [None, "7 days"])
@pytest.mark.parametrize("versions,expected", [((SHORT, FULL), []), ((FULL, SHORT), [("a", 45)])])
def test_both_versions_in_one_batch(arrivals, watermark, versions, expected):
    arrivals.arrive(*[{**v, "store_id": "a"} for v in versions], watermark=watermark)
    assert arrivals.orders() == expected and arrivals.orders(withdrawn=True) == []


def test_all_orders_of_a_date_withdrawn(arrivals):
    arrivals.arrive({**SHORT, "store_id": "a"})
    arrivals.arrive({**FULL, "store_id": "a"})
    assert arrivals.orders() == []


def test_account_of_rows_beyond_the_watermark(spark, arrivals):
    run = arrivals.arrive({**SHORT, "store_id": "a", "date": "2023-05-01"}, {"store_id": "b", "date": "2023-05-20"}, watermark="7 days")
    assert [tuple(r)[1:5] for r in reorder_stream.account(spark, run).collect()] == [(2, 2, 0, 0)]
    run = arrivals.arrive(
        {**FULL, "store_id": "a", "date": "2023-05-01"},                                    # late
        {**SHORT, "store_id": "z", "date": "2023-05-13"},                                   # late by no day
        {**SHORT, "store_id": "y", "date": "2023-05-14"}, {**SHORT, "store_id": "y", "date": "2023-05-14"},
        {**SHORT, "store_id": "x", "date": "2023-05-25"}, watermark="7 days",
    )
    (row,) = reorder_stream.account(spark, run).collect()
    assert tuple(row)[1:5] == (5, 2, 2, 1) and row.watermark.startswith("2023-05-13")
    assert arrivals.orders() == [("a", 45), ("x", 45), ("y", 45)]
    assert reorder_stream.account(spark, arrivals.arrive(watermark="7 days")).collect() == []


def test_lists_lie_by_date_and_only_the_newest_are_read(spark, arrivals):
    arrivals.arrive({**SHORT, "store_id": "a", "date": "2023-05-01"}, {**SHORT, "store_id": "b", "date": "2023-05-02"})
    arrivals.arrive({**SHORT, "store_id": "c", "date": "2023-05-02"})
    arrivals.arrive({**SHORT, "store_id": "d", "date": "2023-05-03"})
    files = {f.split("/out/")[1].rsplit("/", 1)[0] for f in spark.read.parquet(arrivals.output).inputFiles()}
    assert files == {
        "batch_id=0/list_date=2023-05-01", "batch_id=0/list_date=2023-05-02",
        "batch_id=1/list_date=2023-05-02", "batch_id=2/list_date=2023-05-03",
    }
    assert arrivals.orders(dates=["2023-05-02"]) == [("b", 45), ("c", 45)]
    read = reorder_stream.read_orders(spark, arrivals.output)
    used = {r[0].rsplit("/out/")[1].rsplit("/", 1)[0] for r in read.select(F.input_file_name()).collect()}
    assert used == files - {"batch_id=0/list_date=2023-05-02"}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [array_contains" in plan


def test_replaying_a_batch_changes_nothing(spark, arrivals):
    import glob
    import os

    arrivals.arrive({**SHORT, "store_id": "a"}, {**SHORT, "store_id": "b"})
    arrivals.arrive({**FULL, "store_id": "a"}, {**SHORT, "store_id": "c"})
    before = arrivals.orders(), arrivals.orders(withdrawn=True)
    # The last batch wrote its lists, but its commit was lost.
    last = max(glob.glob(f"{arrivals.state}/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    os.rename(last, f"{arrivals.state}/lost")
    os.rename(f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc", f"{arrivals.state}/lost.crc")
    arrivals.arrive()
    assert (arrivals.orders(), arrivals.orders(withdrawn=True)) == before == ([("b", 45), ("c", 45)], [("a", 0)])


def test_nothing_written_yet(spark, tmp_path):
    found = reorder_stream.read_orders(spark, str(tmp_path / "none"))
    assert found.columns == reorder_stream.OUTPUT and found.collect() == []


def test_rows_carry_a_short_name_that_orders_the_files(spark, facts, tmp_path):
    folder = str(tmp_path / "in")
    for store in ("a", "b"):
        facts({"store_id": store}).coalesce(1).write.mode("append").parquet(folder)
    seen = []
    stream = reorder_stream.read_fact_stream(spark, folder + "/").select(
        "store_id", f"{reorder_stream.ARRIVAL}.*", F.col("_metadata.file_path").alias("whole")
    )
    writer = stream.writeStream.foreachBatch(lambda batch, _: seen.extend(batch.collect()))
    writer.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    assert {r.store_id for r in seen} == {"a", "b"}
    assert all(r.file_path.startswith("/part-") and r.whole.endswith(folder + r.file_path) for r in seen)
    def arrived(name):
        return sorted(seen, key=lambda r: (r.file_modification_time, r[name], r.row_index))

    assert arrived("whole") == arrived("file_path")


def test_a_run_reads_in_small_splits(spark, facts, tmp_path):
    folder = str(tmp_path / "in")
    facts(*[{"store_id": str(i)} for i in range(8)]).repartition(8).write.parquet(folder)
    name = "spark.sql.files.maxPartitionBytes"
    before, sizes = spark.conf.get(name), []
    start = reorder_stream.start
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(reorder_stream, "start", lambda *a, **o: (sizes.append(spark.conf.get(name)), start(*a, **o))[1])
        query = reorder_stream.run(
            reorder_stream.read_fact_stream(spark, folder), str(tmp_path / "out"), str(tmp_path / "state")
        )
    assert sizes == [reorder_stream.SPLIT] and spark.conf.get(name) == before
    assert reorder_stream.account(spark, query).first().arrived == 8
