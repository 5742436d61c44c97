"""Time the headline queries; prints one JSON line.

First the driver's tables are mapped and stored as stations, chargers and
sessions (sessions by month): the form the operators are made for. That is timed
as ``ingest`` and counts; the faulty copies for the quality rules are stored
before it and warm the JVM. Then every query is timed from building its plan to
its last result row, on freshly opened tables and with fresh plans, so nothing
is cached or reused between runs. One untimed round warms the JVM; the figure of
a query is the best of ``BENCH_REPEAT`` runs, the value is the sum.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from voltlake.fixtures.mapping import faulty_network, network  # noqa: E402
from voltlake.fixtures.queries import OPERATORS, QUALITY, run  # noqa: E402
from voltlake.session import apply_settings  # noqa: E402
from voltlake.sources.tables import load_tables, write_tables  # noqa: E402

# The queries timed first, in the order of earlier rounds; all others follow.
HEADLINES = (
    "landing_kpis", "period_comparison", "health_score", "daily_trend", "station_30d", "alert_high_failure",
    "station_performance", "station_cpi", "station_profile", "demand_kpis", "peak_windows", "peak_vs_offpeak",
    "demand_heatmap", "charger_stats", "anomaly_log", "revenue_kpis", "revenue_quadrants", "revenue_by_city",
    "area_summary", "capacity_scenarios", "customer_segments", "segment_summary", "vehicle_intelligence",
    "dq_report", "dq_summary", "insights", "noc_station_health", "sql02_station_performance",
    "sql03_charger_failure", "sql06_monthly_revenue", "sql07_top_stations", "sql10_customer_buckets",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("voltlake-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    apply_settings(spark)
    folder = tempfile.mkdtemp(prefix="voltlake-bench-")
    seconds: dict[str, float] = {}
    write_tables(faulty_network(spark, sf_dir), f"{folder}/faulty")
    start = time.perf_counter()
    write_tables(network(spark, sf_dir), f"{folder}/good")
    seconds["ingest"] = round(time.perf_counter() - start, 3)

    operators = {op.__name__: (op, "good") for op in OPERATORS} | {op.__name__: (op, "faulty") for op in QUALITY}
    wanted = os.environ.get("BENCH_QUERIES")
    every = dict.fromkeys((*HEADLINES, *operators))
    for name in wanted.split(",") if wanted else every:
        operator, kind = operators[name]
        runs = []
        for _ in range(repeat + 1):
            tables = load_tables(spark, f"{folder}/{kind}", "parquet")
            start = time.perf_counter()
            # the rows are computed and dropped: bringing them to the driver would time Python
            run(operator, tables).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs[1:]), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)),
    }))


if __name__ == "__main__":
    main()
