"""Station metrics with coordinates and the area summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.operators.station import indexed_stations
from voltlake.plans.rollups import resum
from voltlake.sources.filters import ALL, GlobalFilter
from voltlake.sources.tables import Tables

GEO = (
    "station_id", "station_name", "city", "area", "latitude", "longitude", "sessions",
    "revenue", "utilization_pct", "failure_rate_pct", "cpi",
)


def geo_metrics(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """Volume, utilization, failure and pressure index of every station, with its coordinates."""
    return indexed_stations(t, flt).select(*GEO)


def geo_threshold_filter(
    t: Tables, min_util: float = 0, min_revenue: float = 0, min_fail: float = 0, min_cpi: int = 0,
    city: str | None = None, flt: GlobalFilter = ALL,
) -> DataFrame:
    """Stations that reach every floor."""
    out = geo_metrics(t, flt)
    if city is not None:
        out = out.filter(F.col("city") == F.lit(city))
    return out.filter(
        (F.col("utilization_pct") >= min_util)
        & (F.col("revenue") >= min_revenue)
        & (F.col("failure_rate_pct") >= min_fail)
        & (F.col("cpi") >= min_cpi)
    )


def area_summary(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """Stations, sessions and plain means over the stations of each area."""
    stations = geo_metrics(t, flt).filter(F.col("area").isNotNull())
    return stations.groupBy("area").agg(
        F.count("station_id").alias("stations"),
        *resum("sessions"),
        F.round(F.avg("utilization_pct"), 6).alias("avg_utilization_pct"),
        F.round(F.avg("cpi"), 6).alias("avg_cpi"),
        F.round(F.avg("failure_rate_pct"), 6).alias("avg_failure_rate_pct"),
    )


def _first(ordered: DataFrame, n: int | None) -> DataFrame:
    return ordered if n is None else ordered.limit(n)


def area_high_demand(t: Tables, n: int = 3, flt: GlobalFilter = ALL) -> DataFrame:
    return area_summary(t, flt).orderBy(F.col("sessions").desc(), "area").limit(n)


def area_high_pressure(t: Tables, cpi: float = 50, n: int | None = None, flt: GlobalFilter = ALL) -> DataFrame:
    hits = area_summary(t, flt).filter(F.col("avg_cpi") > cpi)
    return _first(hits.orderBy(F.col("avg_cpi").desc(), "area"), n)


def area_underutilized(t: Tables, util: float = 2, n: int | None = None, flt: GlobalFilter = ALL) -> DataFrame:
    hits = area_summary(t, flt).filter(F.col("avg_utilization_pct") < util)
    return _first(hits.orderBy("avg_utilization_pct", "area"), n)


def area_risk(t: Tables, fail: float = 3, n: int | None = None, flt: GlobalFilter = ALL) -> DataFrame:
    hits = area_summary(t, flt).filter(F.col("avg_failure_rate_pct") > fail)
    return _first(hits.orderBy(F.col("avg_failure_rate_pct").desc(), "area"), n)
