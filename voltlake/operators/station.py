"""Station performance, the charging-pressure index and station profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions import calendar as cal
from voltlake.functions import measures as m
from voltlake.operators.model import station_status
from voltlake.plans.rollups import VOLUME, active_chargers, station_profile_rollup, station_rollup
from voltlake.sources.filters import ALL, GlobalFilter, filtered_sessions
from voltlake.sources.tables import Tables

# Categories of the pressure index, lowest first.
PRESSURE_CATEGORIES = ("Low Pressure", "Moderate Pressure", "High Pressure", "Critical Pressure")


def _all_stations(t: Tables, rollup: DataFrame) -> DataFrame:
    """Every station with its rollup (0 where it has no sessions) and active chargers."""
    joined = t.stations.join(rollup, "station_id", "left").join(
        active_chargers(t.chargers), "station_id", "left"
    )
    zero = {c: 0 for c in (*VOLUME, "rows", "active_chargers") if c in joined.columns}
    return joined.na.fill(zero)


def _with_rates(df: DataFrame, days: Column) -> DataFrame:
    return df.withColumn("days", days).select(
        "*",
        m.from_units("revenue_u").alias("revenue"),
        m.from_units("energy_u").alias("energy_kwh"),
        (m.rate("failed", "sessions") * 100.0).alias("failure_rate_pct"),
        m.open_rate("minutes", "completed", 0.0).alias("avg_session_duration"),
        m.open_rate(m.from_units("revenue_u"), "completed", 0.0).alias("avg_revenue_per_session"),
        m.station_utilization("minutes", "active_chargers", F.col("days")).alias("utilization_pct"),
    )


PERFORMANCE = (
    "sessions", "revenue", "energy_kwh", "minutes", "failed", "completed", "failure_rate_pct",
    "avg_session_duration", "avg_revenue_per_session", "active_chargers", "utilization_pct",
)


def station_performance(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """Volume, failure, averages per completed session and utilization of every station."""
    s = filtered_sessions(t, flt)
    out = _with_rates(_all_stations(t, station_rollup(s)), cal.date_span(s))
    return out.select("station_id", "station_name", F.col("total_chargers").cast("long").alias("total_chargers"), *PERFORMANCE)


def pressure_parts(
    utilization: Column, peak_ratio: Column, per_charger_day: Column, failure: Column,
    util_full: float = 25, peak_full: float = 3, queue_full: float = 10, fail_full: float = 5,
) -> tuple[Column, Column, Column, Column]:
    """The four parts of the index, each 0..100."""
    return (
        m.pressure(utilization, util_full),
        m.pressure(peak_ratio, peak_full),
        m.pressure(per_charger_day, queue_full),
        m.pressure(failure, fail_full),
    )


def pressure_index(parts: Sequence[Column], weights: Sequence[float] = (0.35, 0.25, 0.20, 0.20)) -> Column:
    first, *rest = [p * float(w) for p, w in zip(parts, weights)]
    for part in rest:
        first = first + part
    return first


def _with_index(
    df: DataFrame, util_full=25, peak_full=3, queue_full=10, fail_full=5,
    weights=(0.35, 0.25, 0.20, 0.20), cuts=(25, 50, 75),
) -> DataFrame:
    """Add the index; stations without sessions or active chargers get zeros and the lowest category."""
    used = (F.col("rows") > 0) & (F.col("active_chargers") > 0)
    parts = pressure_parts(
        F.col("utilization_pct"),
        m.rate("busiest", "mean_hour"),
        m.rate("sessions", F.col("active_chargers") * F.col("days")),
        F.col("failure_rate_pct"),
        util_full, peak_full, queue_full, fail_full,
    )
    names = ("util_part", "peak_part", "queue_part", "fail_part")
    df = df.withColumns({n: F.when(used, p).otherwise(F.lit(0.0)) for n, p in zip(names, parts)})
    df = df.withColumn("index", pressure_index([F.col(n) for n in names], weights))
    category = F.lit(PRESSURE_CATEGORIES[3])
    for cut, name in reversed(list(zip(cuts, PRESSURE_CATEGORIES))):
        category = F.when(F.col("index") <= cut, name).otherwise(category)
    return df.withColumns({
        "util_pressure": m.as_long("util_part"),
        "peak_pressure": m.as_long("peak_part"),
        "queue_pressure": m.as_long("queue_part"),
        "fail_pressure": m.as_long("fail_part"),
        "cpi": m.as_long("index"),
        "cpi_category": F.when(used, category).otherwise(PRESSURE_CATEGORIES[0]),
    })


INDEX = ("util_pressure", "peak_pressure", "queue_pressure", "fail_pressure", "cpi", "cpi_category")


def indexed_stations(t: Tables, flt: GlobalFilter = ALL, by_date: bool = False, **scale) -> DataFrame:
    """Performance and pressure index of every station, from one pass over the fact."""
    s = filtered_sessions(t, flt)
    rollup = station_profile_rollup(s, by_date=by_date)
    return _with_index(_with_rates(_all_stations(t, rollup), cal.date_span(s)), **scale)


def station_cpi(
    t: Tables, util_full: float = 25, peak_full: float = 3, queue_full: float = 10, fail_full: float = 5,
    weights: Sequence[float] = (0.35, 0.25, 0.20, 0.20), cuts: Sequence[float] = (25, 50, 75),
    flt: GlobalFilter = ALL,
) -> DataFrame:
    """Charging-pressure index per station.

    The category follows the untruncated index: 25.4 shows as 25 and is Moderate.
    """
    out = indexed_stations(
        t, flt, util_full=util_full, peak_full=peak_full, queue_full=queue_full,
        fail_full=fail_full, weights=weights, cuts=cuts,
    )
    return out.select("station_id", "station_name", *INDEX)


def station_profile(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """Everything known about each station, for all stations at once."""
    out = indexed_stations(t, flt, by_date=True)
    peak_day = m.rate("peak_day_minutes", F.col("active_chargers") * m.MINUTES_PER_DAY) * 100.0
    return out.join(station_status(t).select("station_id", "station_status"), "station_id").select(
        "station_id", "station_name", "city", "area", "station_type", "station_status",
        F.col("total_chargers").cast("long").alias("total_chargers"), *PERFORMANCE, *INDEX,
        "busiest_hour", "busiest_day", peak_day.alias("peak_day_utilization_pct"),
    )
