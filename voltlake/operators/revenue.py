"""Revenue KPIs, the utilization/revenue matrix and revenue by dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions import calendar as cal
from voltlake.functions import measures as m
from voltlake.functions.quantiles import quantiles
from voltlake.sources.filters import ALL, GlobalFilter, filtered_sessions
from voltlake.sources.tables import Tables


def _positive_rate(n: Column | str, d: Column | str) -> Column:
    d = F.col(d) if isinstance(d, str) else d
    return F.when(d > 0, m.rate(n, d)).otherwise(F.lit(0.0))


def _by_station_and_charger(sessions: DataFrame) -> DataFrame:
    """Distinct counts are read from these few rows, not from the fact."""
    return sessions.groupBy("station_id", "charger_id").agg(
        F.count(F.lit(1)).alias("rows"),
        m.count_status("Completed").alias("completed"),
        m.sum_units("revenue").alias("revenue_u"),
        m.sum_units("energy_kwh").alias("energy_u"),
        m.sum_long("duration_minutes").alias("minutes"),
    )


def _distinct_with_null(column: str) -> Column:
    """Distinct values, an unknown one counting once."""
    return F.count_distinct(F.col(column)) + F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))


def revenue_kpis(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """Revenue in total and per session, completed session, kWh, charger, station and operating hour."""
    pairs = _by_station_and_charger(filtered_sessions(t, flt))
    totals = pairs.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "completed", "revenue_u", "energy_u", "minutes")],
        _distinct_with_null("charger_id").alias("chargers"),
        _distinct_with_null("station_id").alias("stations"),
    )
    return totals.select(
        m.from_units("revenue_u").alias("total_revenue"),
        m.from_units("energy_u").alias("total_energy_kwh"),
        F.col("rows").alias("total_sessions"),
        F.col("completed").alias("completed_sessions"),
        m.as_long("chargers").alias("chargers_seen"),
        m.as_long("stations").alias("stations_seen"),
        (F.col("minutes") / F.lit(60.0)).alias("operating_hours"),
    ).select(
        "total_revenue",
        "total_energy_kwh",
        "total_sessions",
        "completed_sessions",
        "chargers_seen",
        "stations_seen",
        _positive_rate("total_revenue", "total_sessions").alias("revenue_per_session"),
        _positive_rate("total_revenue", "completed_sessions").alias("avg_transaction_value"),
        _positive_rate("total_revenue", "total_energy_kwh").alias("revenue_per_kwh"),
        _positive_rate("total_revenue", "chargers_seen").alias("revenue_per_charger"),
        _positive_rate("total_revenue", "stations_seen").alias("revenue_per_station"),
        _positive_rate("total_revenue", "operating_hours").alias("revenue_per_operating_hour"),
    )


def revenue_quadrants(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """Stations with sessions, split at the medians of utilization and revenue (>= is High)."""
    s = filtered_sessions(t, flt)
    pairs = s.filter(F.col("station_id").isNotNull()).groupBy("station_id", "charger_id").agg(
        m.sum_units("revenue").alias("revenue_u"), m.sum_long("duration_minutes").alias("minutes")
    )
    per_station = pairs.groupBy("station_id").agg(
        F.sum("revenue_u").alias("revenue_u"),
        F.sum("minutes").alias("minutes"),
        F.count("charger_id").alias("chargers_seen"),
    )
    named = t.stations.select("station_id", "station_name").filter(F.col("station_name").isNotNull())
    stations = per_station.join(named, "station_id").select(
        "station_id", "station_name",
        m.from_units("revenue_u").alias("revenue"),
        "minutes", "chargers_seen",
        m.seen_charger_utilization("minutes", "chargers_seen", cal.date_span(s)).alias("utilization_pct"),
    )
    medians = quantiles(stations, {"revenue": [0.5], "utilization_pct": [0.5]})
    high_util = F.col("utilization_pct") >= F.col("q.utilization_pct")[0]
    high_revenue = F.col("revenue") >= F.col("q.revenue")[0]
    return stations.withColumn("q", medians).withColumn(
        "quadrant",
        F.concat(
            F.when(high_util, "High Util").otherwise("Low Util"),
            F.lit(" / "),
            F.when(high_revenue, "High Rev").otherwise("Low Rev"),
        ),
    ).drop("q")


def _revenue_by(sessions: DataFrame, key: Column, name: str) -> DataFrame:
    """Exact revenue per key; rows without a key are in no group."""
    keyed = sessions.select(key.alias(name), "revenue").filter(F.col(name).isNotNull())
    return keyed.groupBy(name).agg(m.exact_sum("revenue").alias("revenue"))


def _revenue_by_dimension(sessions: DataFrame, key: str, dimension: DataFrame, name: str) -> DataFrame:
    """Aggregate by the fact's key, then join the dimension and aggregate again."""
    per_key = sessions.filter(F.col(key).isNotNull()).groupBy(key).agg(m.sum_units("revenue").alias("u"))
    named = per_key.join(dimension.select(key, name).filter(F.col(name).isNotNull()), key)
    return named.groupBy(name).agg(m.from_units(F.sum("u")).alias("revenue"))


def revenue_by_day(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    return _revenue_by(filtered_sessions(t, flt), cal.day(), "date").orderBy("date")


def revenue_top_stations(t: Tables, n: int = 10, flt: GlobalFilter = ALL) -> DataFrame:
    """The ``n`` station names with most revenue."""
    by_name = _revenue_by_dimension(filtered_sessions(t, flt), "station_id", t.stations, "station_name")
    return by_name.orderBy(F.col("revenue").desc(), "station_name").limit(n)


def revenue_by_city(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    return _revenue_by_dimension(filtered_sessions(t, flt), "station_id", t.stations, "city").orderBy("city")


def revenue_by_charger_type(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    by_type = _revenue_by_dimension(filtered_sessions(t, flt), "charger_id", t.chargers, "charger_type")
    return by_type.orderBy("charger_type")


def revenue_by_vehicle(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """Revenue per vehicle type, most first."""
    by_type = _revenue_by(filtered_sessions(t, flt), F.col("vehicle_type"), "vehicle_type")
    return by_type.orderBy(F.col("revenue").desc(), "vehicle_type")


def revenue_by_hour(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    return _revenue_by(filtered_sessions(t, flt), cal.hour(), "hour").orderBy("hour")
