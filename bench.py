"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select
the data and the cores. Each query runs once to warm up and three times for
the record; the median counts. Stored layers (raw, clean, quarantine, star) are built
before, and their build times are listed separately.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyhouse.plans import cleanse  # noqa: E402
from tallyhouse.sources.entities import ENTITIES  # noqa: E402
from tallyhouse.testbed import catalog  # noqa: E402
from tallyhouse.testbed.tables import tables  # noqa: E402

HEADLINE = [
    "val_07_orders_split",
    "val_10_transactions_split",
    "agg_06_best_record",
    "sch_06_fact_transactions",
    "sch_07_fact_returns",
    "sch_07_fact_returns_per_line",
    "kpi_01_revenue_by_region",
    "kpi_02_vendor_returns",
    "kpi_03_inventory_velocity",
    "kpi_10_high_return_products",
    "frd_02_scores",
    "prf_01_profile_lineitem",
    "prf_18_readiness",
    "dq_03_quarantine_rates",
    "dq_07_referential_integrity",
    "aud_05_overstatement",
    "rag_03_nearest_vectors",
    "src_02_csv_by_name",
]
RUNS = 3


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    layers = tables(spark, sf_dir)

    build = {"raw": timed(lambda: [layers.raw(e) for e in ENTITIES])}
    build["clean"] = timed(lambda: [layers.clean(e) for e in ENTITIES])
    build["quarantine"] = timed(lambda: layers.all_quarantine)
    star = layers.star()
    build["star"] = timed(lambda: (star.fact_transactions, star.fact_returns(), star.dim_date))

    seconds: dict[str, float] = {}
    # deduplication itself, not the read of the stored result
    special = {"agg_06_best_record": lambda: cleanse.clean(layers.raw("customers"), "customers")}
    for name in HEADLINE:
        query = special.get(name, lambda name=name: queries[name](spark, sf_dir))
        timed(lambda: run(query()))
        seconds[name] = statistics.median(timed(lambda: run(query())) for _ in range(RUNS))
    print(
        json.dumps(
            {
                "metric": "sum of median seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "build": {k: round(v, 3) for k, v in build.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
