"""Headline queries, timed the way the baseline was: a loaded table, mean of 5 runs.

Prints one JSON line. ``load_fact`` is one load (join, clean, store) in a warm
session; the first one, with start-up, is ``cold_start_load_sec``. The other numbers
are full query times on the stored tables, planning included, result fetched.
"""

import dataclasses
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from stockyard import schema as S
from stockyard.plans import queries as plans
from stockyard.session import build_session, materialize
from stockyard.sources import retail_star

RUNS = 5
WARM_UPS = 2
HEADLINE = [
    # the three timed by the baseline
    "product_performance", "store_performance", "category_performance",
    # the rest of the catalogue's main reports
    "network_kpis", "quality_summary", "duplicate_keys", "describe_numeric", "iqr_outliers",
    "risk_distribution", "risk_by_product", "forecast_accuracy", "accuracy_by_store_category",
    "accuracy_by_risk", "drivers_weather", "overstock_by_product", "monthly_sell_through",
    "kpi_summary", "movement_metrics", "movement_segments", "movement_segments_qcut",
    "pivot_conditional", "reorder_recommendation", "trend_reorder_point", "normalize_fact",
]


def run(query, inventory):
    start = time.perf_counter()
    result = query(inventory)
    if result.columns[0] == "date" and len(result.columns) > 10:
        result.write.format("noop").mode("overwrite").save()  # whole-table result
    else:
        result.collect()
    return time.perf_counter() - start


def throughput(spark, inventory, catalog, copies=20):
    """The baseline's three queries over copies of the fact, where fixed costs fade."""
    many = inventory.fact.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    large = materialize(many.drop("_copy", *S.GRAINS), "bench")
    inventory = dataclasses.replace(inventory, fact=large)
    result = {"fact_rows": large.count()}
    for name in HEADLINE[:3]:
        run(catalog[name], inventory)
        seconds = sum(run(catalog[name], inventory) for _ in range(3)) / 3
        result[name] = {"sec": round(seconds, 3), "rows_per_sec": round(result["fact_rows"] / seconds)}
    return result


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "stockyard-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    inventory = retail_star.load(spark, folder)
    cold = time.perf_counter() - start
    start = time.perf_counter()
    retail_star.store(spark, folder)
    loaded = time.perf_counter() - start
    rows = inventory.fact.count()
    catalog = plans.catalog()
    times = {"load_fact": round(loaded, 3)}
    for _ in range(WARM_UPS):
        for name in HEADLINE:
            run(catalog[name], inventory)
    for name in HEADLINE:
        times[name] = round(sum(run(catalog[name], inventory) for _ in range(RUNS)) / RUNS, 3)
    total = sum(times.values())
    scaled = throughput(spark, inventory, catalog)
    print(
        json.dumps(
            {
                "metric": "headline queries, mean of 5 warm runs, plus one load",
                "value": round(total, 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "fact_rows": rows,
                "cold_start_load_sec": round(cold, 3),
                "rows_per_sec": {n: round(rows / times[n]) for n in HEADLINE[:3]},
                "twenty_copies": scaled,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
