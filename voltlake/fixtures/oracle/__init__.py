"""The same results stated in DuckDB SQL, one module per subject."""

from __future__ import annotations

from voltlake.fixtures.oracle.base import NET_ACTIVE, filtered
from voltlake.fixtures.oracle import (
    capacity, charger, customer, demand, distinct, geo, insights, model, network, noc, quality, reports, revenue, station,
)

MODULES = (
    model, network, station, demand, charger, revenue, geo, capacity, customer, distinct, quality, insights, noc, reports,
)

WHERE = {
    "city": """start_time >= TIMESTAMP '2024-11-15 00:00:00' AND start_time < TIMESTAMP '2025-09-01 00:00:00' AND station_id IN
  (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_9')""",
    "station": "station_id = 7",
    "vehicle": "vehicle_type = 'Brand#4'",
}
FILTERED = (
    "station_performance", "station_cpi", "demand_kpis", "peak_vs_offpeak", "period_metrics", "charger_stats", "anomaly_log",
    "revenue_kpis", "customer_kpis", "insights", "revenue_quadrants", "geo_metrics", "area_summary", "capacity_baseline",
    "customer_segments", "segment_summary", "health_score", "daily_trend",
)


def oracle_sql() -> dict[str, str]:
    statements: dict[str, str] = {}
    for module in MODULES:
        statements.update(module.SQL)
    for fmt in ("csv", "parquet"):
        statements[f"{fmt}_station_performance"] = statements["station_performance"]
    for suffix, where in WHERE.items():
        statements.update({f"{name}_of_{suffix}": filtered(statements[name], where) for name in FILTERED})
    # With a station chosen, this operator counts that station's chargers.
    name = "peak_vs_offpeak_of_station"
    statements[name] = statements[name].replace(NET_ACTIVE, f"{NET_ACTIVE} WHERE {WHERE['station']}")
    return statements
