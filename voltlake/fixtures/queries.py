"""One named query per operator, over the mapped driver tables.

Thresholds are the operators' defaults, except where the test data would leave
the result empty; those are named in ``ADJUSTED``.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.fixtures.mapping import faulty_network, network
from voltlake.functions import measures as m
from voltlake.operators import (
    capacity, charger, customer, demand, distinct, geo, insights, model, network as net, noc, quality, reports, revenue, station,
)
from voltlake.sources.filters import GlobalFilter
from voltlake.sources.tables import CHARGERS, SESSION_COLUMNS, STATIONS, Tables, load_raw_tables, load_tables, write_tables

Query = Callable[[SparkSession, str], DataFrame]

SAMPLE_FILTER = GlobalFilter(
    date_from=dt.date(2024, 11, 15), date_to=dt.date(2025, 6, 30),
    charger_type="DC Fast (50kW)", session_status="Completed",
)

# Arguments that differ from the defaults, for selectivity on the test data.
ADJUSTED = {
    "global_filter": {"flt": SAMPLE_FILTER},
    "station_attribute_filter": {"station_type": "Urban", "status": "Degraded"},
    "geo_threshold_filter": {"min_util": 3, "min_revenue": 9000, "min_fail": 4, "min_cpi": 30},
    "anomaly_log_by_severity": {"severities": ("High", "Medium")},
    "alert_overloaded": {"pct": 2},
    "alert_underutilized": {"pct": 2},
    "area_high_pressure": {"cpi": 30},
    "area_underutilized": {"util": 4},
    "insight_capacity_pressure": {"zero_active": "exclude"},
    "insight_revenue_concentration": {"pct": 10},
    "insight_failure": {"ratio": 1.2},
    "anomaly_low_freq": {"k": 0.5},
    "noc_expansion": {"hi": 10},
    "sql09_high_pressure": {"per_day": 0.3},
}

OPERATORS = (
    model.enrich_sessions, model.global_filter, model.filter_facets, model.station_status,
    model.station_attribute_filter,
    net.landing_kpis, net.period_metrics, net.period_comparison, net.health_score, net.daily_trend,
    net.sessions_by_hour, net.sessions_by_dow, net.station_30d, net.alert_high_failure, net.alert_overloaded,
    net.alert_underutilized, net.alert_abnormal_chargers,
    station.station_performance, station.station_cpi, station.station_profile,
    demand.demand_kpis, demand.peak_hours, demand.peak_windows, demand.demand_heatmap, demand.weekday_weekend,
    demand.vehicle_demand, demand.monthly_demand, demand.peak_vs_offpeak,
    charger.charger_stats, charger.anomaly_long_session, charger.anomaly_camper, charger.anomaly_high_failure,
    charger.anomaly_revenue_drop, charger.anomaly_util_drop, charger.anomaly_high_freq, charger.anomaly_low_freq,
    charger.anomaly_log, charger.anomaly_log_by_severity,
    revenue.revenue_kpis, revenue.revenue_quadrants, revenue.revenue_by_day, revenue.revenue_top_stations,
    revenue.revenue_by_city, revenue.revenue_by_charger_type, revenue.revenue_by_vehicle, revenue.revenue_by_hour,
    geo.geo_metrics, geo.geo_threshold_filter, geo.area_summary, geo.area_high_demand, geo.area_high_pressure,
    geo.area_underutilized, geo.area_risk,
    capacity.capacity_baseline, capacity.capacity_scenarios,
    customer.customer_kpis, customer.customer_segments, customer.segment_summary, customer.vehicle_intelligence,
    distinct.trailing_distinct_check,
    insights.insight_capacity_pressure, insights.insight_revenue_concentration, insights.insight_failure,
    insights.insight_underutilized, insights.insight_peak_hour, insights.insight_campers, insights.insights,
    noc.noc_kpis, noc.noc_daily_energy, noc.noc_station_health, noc.noc_zscore_behavior, noc.noc_expansion,
    reports.sql01_network_kpis, reports.sql02_station_performance, reports.sql03_charger_failure,
    reports.sql04_hourly_demand, reports.sql05_daily_demand, reports.sql06_monthly_revenue,
    reports.sql07_top_stations, reports.sql08_underutilized, reports.sql09_high_pressure,
    reports.sql10_customer_buckets, reports.sql11_vehicle_analysis, reports.sql12_anomaly_flags,
)

QUALITY = (
    quality.dq_missing, quality.dq_duplicates, quality.dq_timestamps, quality.dq_negative_energy,
    quality.dq_negative_revenue, quality.dq_durations, quality.dq_station_fk, quality.dq_charger_fk,
    quality.dq_orphan_chargers, quality.dq_inconsistent, quality.dq_report, quality.dq_summary, quality.dq_flags,
)


def run(operator: Callable[..., DataFrame], tables: Tables) -> DataFrame:
    """An operator with its query's arguments on any tables."""
    return operator(tables, **ADJUSTED.get(operator.__name__, {}))


def _query(operator: Callable[..., DataFrame], tables: Callable) -> Query:
    return lambda spark, sf_dir: run(operator, tables(spark, sf_dir))


def _highway_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = network(spark, sf_dir)
    return noc.noc_station_filter(t, t.stations.filter(F.col("station_type") == "Highway"))


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors must share.

    Only a session whose executors are this process may leave it unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="voltlake-")
    return f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"


def _stored(t: Tables, fmt: str) -> Tables:
    """The tables written to the shared folder and opened by the reader. This runs the writing jobs."""
    path = shared_folder(t.sessions.sparkSession)
    undated = t.chargers.withColumn("installation_date", F.lit(None).cast("date"))
    t = Tables(t.stations.select(*STATIONS.names), undated.select(*CHARGERS.names), t.sessions.select(*SESSION_COLUMNS))
    write_tables(t, path, fmt)
    return load_tables(t.sessions.sparkSession, path, fmt)


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and a total per table, after a round trip through parquet."""
    back = _stored(network(spark, sf_dir), "parquet")
    chargers = back.chargers.agg(F.count(F.lit(1)).alias("rows"), m.exact_sum("power_kw").alias("total"))
    sessions = back.sessions.agg(F.count(F.lit(1)).alias("rows"), m.exact_sum("energy_kwh").alias("total"))
    stations = back.stations.agg(
        F.count(F.lit(1)).alias("rows"), (F.coalesce(F.sum(F.col("total_chargers").cast("long")), F.lit(0)) * 1.0).alias("total"),
    )
    named = [
        part.select(F.lit(name).alias("table_name"), "rows", "total")
        for name, part in (("stations", stations), ("chargers", chargers), ("charging_sessions", sessions))
    ]
    return named[0].unionByName(named[1]).unionByName(named[2])


# What is wrong with the raw sessions, by session_id; the first that holds counts.
RAW_FAULTS = {"number": 257, "short": 263, "timestamp": 269, "early": 271}


def _raw(spark: SparkSession, sf_dir: str) -> Tables:
    """The network as CSV text without headers, with broken records, opened by the lenient reader. This runs the writing jobs."""
    t, path = network(spark, sf_dir), shared_folder(spark)
    t.stations.select(*STATIONS.names).write.csv(f"{path}/stations.csv")
    t.chargers.withColumn("installation_date", F.lit(None).cast("date")).select(*CHARGERS.names).write.csv(f"{path}/chargers.csv")
    fault = F.lit(None).cast("string")
    for name, every in reversed(RAW_FAULTS.items()):
        fault = F.when(F.col("session_id") % every == 0, name).otherwise(fault)
    texts = {c: F.col(c).cast("string") for c in SESSION_COLUMNS}
    texts["energy_kwh"] = F.when(F.col("fault") == "number", "n/a").otherwise(texts["energy_kwh"])
    texts["start_time"] = F.when(F.col("fault") == "timestamp", "soon").otherwise(texts["start_time"])
    texts["end_time"] = F.when(F.col("fault") == "early", F.col("start_time").cast("string")).otherwise(texts["end_time"])
    line = F.concat_ws(",", *[F.coalesce(texts[c], F.lit("")) for c in SESSION_COLUMNS])
    short = F.concat_ws(",", *[F.coalesce(texts[c], F.lit("")) for c in SESSION_COLUMNS[:5]])
    lines = t.sessions.withColumn("fault", fault).select(F.when(F.col("fault") == "short", short).otherwise(line).alias("value"))
    lines.write.text(f"{path}/charging_sessions.csv")
    return load_raw_tables(spark, path, header=False)


def _unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First field and number of fields of every broken record."""
    fields = F.split("record", ",")
    return quality.unreadable_records(_raw(spark, sf_dir)).select(
        "table_name", fields[0].alias("session_id"), F.size(fields).alias("fields")
    )


def _performance_of_stored(fmt: str, ids: str) -> Query:
    """Station performance on tables that went through a file format; CSV ids come back as text."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = station.station_performance(_stored(network(spark, sf_dir), fmt))
        return done.withColumn("station_id", F.col("station_id").cast(ids))
    return query


# Filters that together set every restriction but the status and charger type (SAMPLE_FILTER has those).
FILTERS = {
    "city": GlobalFilter(city="NATION_9", date_from=dt.date(2024, 11, 15), date_to=dt.date(2025, 8, 31)),
    "station": GlobalFilter(station_id=7),
    "vehicle": GlobalFilter(vehicle_type="Brand#4"),
}
FILTERED = (
    station.station_performance, station.station_cpi, demand.demand_kpis, demand.peak_vs_offpeak, net.period_metrics,
    charger.charger_stats, charger.anomaly_log, revenue.revenue_kpis, customer.customer_kpis, insights.insights,
    revenue.revenue_quadrants, geo.geo_metrics, geo.area_summary, capacity.capacity_baseline, customer.customer_segments,
    customer.segment_summary, net.health_score, net.daily_trend,
)


def _filtered(operator: Callable[..., DataFrame], flt: GlobalFilter) -> Query:
    return lambda spark, sf_dir: operator(
        network(spark, sf_dir), **{**ADJUSTED.get(operator.__name__, {}), "flt": flt}
    )


def queries() -> dict[str, Query]:
    named = {op.__name__: _query(op, network) for op in OPERATORS}
    named.update({op.__name__: _query(op, faulty_network) for op in QUALITY})
    named["noc_station_filter"] = _highway_stations
    named["raw_scan"] = _query(quality.raw_scan, _raw)
    named["unreadable_records"] = _unreadable
    named["write_tables"] = _written
    named["csv_station_performance"] = _performance_of_stored("csv", "long")
    named["parquet_station_performance"] = _performance_of_stored("parquet", "long")
    for suffix, flt in FILTERS.items():
        named.update({f"{op.__name__}_of_{suffix}": _filtered(op, flt) for op in FILTERED})
    return named
