"""Headline timings: stores an archive derived from the events table, then asks it the three queries. Prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Ingestion is timed once; each query is run once to warm up and then three
times, of which the median counts.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from palimpsest import workload
from palimpsest.model import TriplePattern
from palimpsest.sources.store import Store


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-")
    try:
        spark.range(1000).selectExpr("sum(id)").collect()
        began = time.perf_counter()
        events = Store(spark, f"{folder}/events").create(workload.events_archive(spark, sf_dir))
        times = {"ingest_events": time.perf_counter() - began}
        began = time.perf_counter()
        orders = Store(spark, f"{folder}/orders").create(workload.orders_archive(spark, sf_dir))
        times["ingest_orders"] = time.perf_counter() - began
        began = time.perf_counter()
        lines = Store(spark, f"{folder}/lines").create(workload.lines_archive(spark, sf_dir), ("pos", "osp"))
        times["ingest_lines"] = time.perf_counter() - began
        lines.compact()
        part, li = TriplePattern(None, "part77"), lines.open()
        e, o, p, sp = events.open(), orders.open(), TriplePattern(None, "did"), TriplePattern("u5", "did")
        urgent = workload.URGENT
        asked = {
            "vm_first": lambda: e.vm(0),
            "vm_middle": lambda: e.vm(workload.MIDDLE),
            "vm_last": lambda: e.vm(workload.LAST),
            "vm_p": lambda: e.vm(22, p),
            "vm_sp": lambda: e.vm(22, sp),
            "vm_page": lambda: e.vm(22, offset=100, limit=50),
            "dm_adjacent": lambda: e.dm(20, 21),
            "dm_far": lambda: e.dm(0, workload.LAST),
            "dm_sp": lambda: e.dm(7, 22, sp),
            "vq_all": lambda: e.vq(),
            "vq_p": lambda: e.vq(p),
            "vq_sp": lambda: e.vq(sp),
            "count_vm": lambda: e.count_vm(22, p),
            "count_dm": lambda: e.count_dm(7, 22),
            "orders_vm_p": lambda: o.vm(5, urgent),
            "orders_dm_p": lambda: o.dm(1, 5, urgent),
            "orders_vq_p": lambda: o.vq(urgent),
            "lines_vm_p": lambda: li.vm(5, part),
            "lines_dm_p": lambda: li.dm(1, 5, part),
            "lines_vq_p": lambda: li.vq(part),
            "lines_count_vm_p": lambda: li.count_vm(5, part),
        }
        for name, f in asked.items():
            taken = []
            for k in range(4):
                began = time.perf_counter()
                f().write.format("noop").mode("overwrite").save()
                if k:
                    taken.append(time.perf_counter() - began)
            times[name] = statistics.median(taken)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        spark.stop()
    times = {k: round(v, 4) for k, v in times.items()}
    print(json.dumps({"metric": "archive_queries_total", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
