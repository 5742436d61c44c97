"""The twelve standing reports over the whole tables.

Sums over no rows are NULL here, as in SQL; division is fractional; NULL sorts last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions import calendar as cal
from voltlake.functions import measures as m
from voltlake.plans.rollups import active_chargers, sorted_once
from voltlake.sources.tables import Tables

YEAR = 365


def _sql_units(c: str) -> Column:
    return m.total_units(c)


def _mean(c: str) -> Column:
    """Mean of an integer column from its exact sum."""
    return m.sql_rate(F.sum(m.as_long(c)), F.count(c))


def sql01_network_kpis(t: Tables) -> DataFrame:
    totals = t.sessions.agg(
        F.count("session_id").alias("total_sessions"),
        m.count_status("Completed").alias("completed"),
        m.from_units(_sql_units("energy_kwh")).alias("total_energy_kwh"),
        m.from_units(_sql_units("revenue")).alias("total_revenue_usd"),
        _mean("duration_minutes").alias("avg_duration_minutes"),
    )
    return totals.select(
        "total_sessions", "total_energy_kwh", "total_revenue_usd", "avg_duration_minutes",
        m.sql_rate("total_revenue_usd", "completed").alias("avg_revenue_per_session"),
        m.sql_rate(F.col("completed") * 100.0, "total_sessions").alias("network_success_rate"),
    )


def sql02_station_performance(t: Tables) -> DataFrame:
    """Lifetime volume per station, aggregated before the outer join."""
    load = t.sessions.filter(F.col("station_id").isNotNull()).groupBy("station_id").agg(
        F.count("session_id").alias("n"),
        m.from_units(_sql_units("revenue")).alias("total_revenue"),
        m.from_units(_sql_units("energy_kwh")).alias("total_energy"),
        _mean("duration_minutes").alias("avg_duration"),
        m.count_status("Failed").alias("failed"),
    )
    joined = t.stations.select("station_id", "station_name", "city").join(load, "station_id", "left")
    return joined.select(
        "station_id", "station_name", "city",
        F.coalesce("n", F.lit(0)).alias("total_sessions"),
        "total_revenue", "total_energy", "avg_duration",
        m.sql_rate(F.col("failed") * 100.0, "n").alias("failure_rate_pct"),
    ).orderBy(F.col("total_revenue").desc_nulls_last(), "station_id")


def sql03_charger_failure(t: Tables, min_sessions: int = 10) -> DataFrame:
    """Failure rate of chargers with more than ``min_sessions`` attempts, worst first."""
    attempts = t.sessions.filter(F.col("charger_id").isNotNull()).groupBy("charger_id").agg(
        F.count("session_id").alias("total_attempts"), m.count_status("Failed").alias("total_failures")
    ).filter(F.col("total_attempts") > min_sessions)
    rated = attempts.withColumn("failure_rate_pct", m.sql_rate(F.col("total_failures") * 100.0, "total_attempts"))
    return (
        t.chargers.select("charger_id", "station_id", "charger_type").join(rated, "charger_id")
        .orderBy(F.col("failure_rate_pct").desc_nulls_last(), "charger_id")
        .select("charger_id", "station_id", "charger_type", "total_attempts", "total_failures", "failure_rate_pct")
    )


def sql04_hourly_demand(t: Tables) -> DataFrame:
    return t.sessions.groupBy(cal.hour().alias("hour_of_day")).agg(
        F.count("session_id").alias("total_sessions"),
        m.from_units(_sql_units("energy_kwh")).alias("total_energy"),
        m.from_units(_sql_units("revenue")).alias("total_revenue"),
    ).orderBy("hour_of_day")


def sql05_daily_demand(t: Tables) -> DataFrame:
    """By weekday number, 1 = Sunday."""
    return t.sessions.groupBy(F.dayofweek("start_time").cast("long").alias("day_of_week_num")).agg(
        F.count("session_id").alias("total_sessions"),
        _mean("duration_minutes").alias("avg_duration"),
        m.from_units(_sql_units("energy_kwh")).alias("total_energy"),
    ).orderBy("day_of_week_num")


def sql06_monthly_revenue(t: Tables) -> DataFrame:
    """Revenue per month with its running total; the window sees one row per month."""
    months = t.sessions.groupBy(F.trunc(cal.day(), "month").alias("month")).agg(
        F.count("session_id").alias("total_sessions"), _sql_units("revenue").alias("u")
    )
    running = F.sum("u").over(Window.orderBy("month"))
    return months.select(
        F.col("month").cast("timestamp_ntz").alias("billing_month"),
        "total_sessions",
        m.from_units("u").alias("gross_revenue_usd"),
        m.from_units(running).alias("cumulative_revenue_usd"),
    ).orderBy("billing_month")


def sql07_top_stations(t: Tables, n: int = 10) -> DataFrame:
    """The ``n`` stations with most revenue, ranked with ties.

    The rank of a row in the first ``n`` depends on these rows only, so they are
    cut first (a distributed top-n) and ranked then.
    """
    revenue = t.sessions.filter(F.col("station_id").isNotNull()).groupBy("station_id").agg(
        m.from_units(_sql_units("revenue")).alias("total_revenue")
    )
    named = revenue.join(t.stations.select("station_id", "station_name", "city"), "station_id")
    first = named.orderBy(F.col("total_revenue").desc_nulls_last(), "station_id").limit(n)
    rank = F.rank().over(Window.orderBy(F.col("total_revenue").desc_nulls_last()))
    return first.withColumn("revenue_rank", rank.cast("long")).orderBy("revenue_rank", "station_id").select(
        "station_name", "city", "total_revenue", "revenue_rank"
    )


def sql08_underutilized(t: Tables, pct: float = 2, days: int = YEAR) -> DataFrame:
    """Stations with active chargers used below ``pct`` of ``days`` days."""
    load = t.sessions.filter(F.col("station_id").isNotNull()).groupBy("station_id").agg(
        F.count("session_id").alias("total_sessions"), F.sum(m.as_long("duration_minutes")).alias("minutes")
    )
    joined = t.stations.join(active_chargers(t.chargers), "station_id").join(load, "station_id")
    used = m.sql_rate("minutes", F.col("active_chargers") * (days * m.MINUTES_PER_DAY)) * 100.0
    return (
        joined.withColumn("est_utilization_pct", used)
        .filter(F.col("est_utilization_pct") < pct)
        .orderBy("est_utilization_pct", "station_id")
        .select("station_name", "city", "active_chargers", "total_sessions", "est_utilization_pct")
    )


def sql09_high_pressure(t: Tables, per_day: float = 15, days: int = YEAR) -> DataFrame:
    """Stations with more than ``per_day`` sessions per active charger and day."""
    load = t.sessions.filter(F.col("station_id").isNotNull()).groupBy("station_id").agg(
        F.count("session_id").alias("total_sessions")
    )
    joined = t.stations.join(active_chargers(t.chargers), "station_id").join(load, "station_id")
    turnover = m.sql_rate("total_sessions", F.col("active_chargers") * days)
    return (
        joined.withColumn("sessions_per_charger_per_day", turnover)
        .filter(F.col("sessions_per_charger_per_day") > per_day)
        .orderBy(F.col("sessions_per_charger_per_day").desc(), "station_id")
        .select("station_name", "city", "active_chargers", "total_sessions", "sessions_per_charger_per_day")
    )


def sql10_customer_buckets(t: Tables) -> DataFrame:
    """Customers by number of visits."""
    visits = t.sessions.groupBy("customer_id").agg(F.count("session_id").alias("visits"))
    v = F.col("visits")
    bucket = (
        F.when(v == 1, "Single Use")
        .when(v.between(2, 5), "Occasional (2-5)")
        .when(v.between(6, 20), "Regular (6-20)")
        .otherwise("Power User (21+)")
    )
    return visits.groupBy(bucket.alias("customer_segment")).agg(
        F.count("customer_id").alias("customer_count"), F.sum("visits").alias("total_network_visits")
    ).orderBy(F.col("customer_count").desc(), "customer_segment")


def sql11_vehicle_analysis(t: Tables) -> DataFrame:
    energy = _sql_units("energy_kwh")
    return t.sessions.groupBy("vehicle_type").agg(
        F.count("session_id").alias("total_sessions"),
        m.from_units(energy).alias("total_energy_kwh"),
        m.sql_rate(m.from_units(energy), F.count("energy_kwh")).alias("avg_kwh_per_session"),
        _mean("duration_minutes").alias("avg_duration_minutes"),
        m.from_units(_sql_units("revenue")).alias("total_revenue"),
    ).orderBy(F.col("total_sessions").desc(), "vehicle_type")


def sql12_anomaly_flags(t: Tables, minutes: int = 240, kwh: float = 2, abort: int = 5) -> DataFrame:
    """Idle campers and immediate aborts, longest first."""
    camper = (F.col("duration_minutes") > minutes) & (F.col("energy_kwh") < float(kwh))
    aborted = (F.col("duration_minutes") < abort) & (F.col("energy_kwh") == 0)
    found = sorted_once(
        t.sessions.filter(camper | aborted),
        F.col("duration_minutes").desc(), "start_time", "session_id", "station_id", "charger_id",
    )
    return found.select(
        "session_id", "station_id", "charger_id",
        m.as_long("duration_minutes").alias("duration_minutes"),
        "energy_kwh",
        F.when(camper, "Idle Camper").otherwise("Immediate Failure/Abort").alias("anomaly_flag"),
    )
