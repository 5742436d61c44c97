"""Customer KPIs and segments, vehicle intelligence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions import calendar as cal
from voltlake.functions import measures as m
from voltlake.functions.quantiles import quantiles
from voltlake.sources.filters import ALL, GlobalFilter, filtered_sessions
from voltlake.sources.tables import Tables

# Customer segments in order of precedence.
SEGMENTS = ("High Revenue", "High Frequency", "High Energy", "Occasional")


def _customers(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.count("session_id").alias("total_sessions"),
        m.exact_sum("energy_kwh").alias("total_energy_kwh"),
        m.exact_sum("revenue").alias("total_revenue"),
    )


def customer_kpis(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """Averages per customer, share of repeat customers, sessions per customer and 30 days."""
    s = filtered_sessions(t, flt)
    per_customer = s.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.count("session_id").alias("sessions"),
        m.sum_units("energy_kwh").alias("energy_u"),
        m.sum_units("revenue").alias("revenue_u"),
        m.sql_rate(F.sum(m.as_long("duration_minutes")), F.count("duration_minutes")).alias("avg_duration"),
    )
    totals = per_customer.agg(
        F.count(F.lit(1)).alias("customers"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sessions", "energy_u", "revenue_u")],
        F.avg("avg_duration").alias("avg_duration"),
        F.count_if(F.col("sessions") > 1).alias("repeat_customers"),
    )
    mean_sessions = m.rate("sessions", "customers")
    return totals.select(
        "customers",
        mean_sessions.alias("avg_sessions_per_customer"),
        m.rate(m.from_units("energy_u"), "customers").alias("avg_energy_per_customer"),
        m.rate(m.from_units("revenue_u"), "customers").alias("avg_revenue_per_customer"),
        F.round("avg_duration", 6).alias("avg_session_duration"),
        "repeat_customers",
        (m.rate("repeat_customers", "customers") * 100.0).alias("repeat_rate_pct"),
        (mean_sessions / (cal.date_span(s) / F.lit(30.0))).alias("sessions_per_30_days"),
    )


def customer_segments(
    t: Tables, q: float = 0.75, flt: GlobalFilter = ALL
) -> DataFrame:
    """One segment per customer: the first of revenue, sessions, energy that reaches its quantile.

    The three quantiles are exact and computed together; the customer totals are
    shuffled once and read by all of them.
    """
    c = _customers(filtered_sessions(t, flt))
    cuts = quantiles(
        c, {"total_revenue": [q], "total_sessions": [q], "total_energy_kwh": [q]}
    )
    reaches = {name: F.col(name) >= F.col(f"q.{name}")[0] for name in c.columns if name.startswith("total_")}
    return c.withColumn("q", cuts).withColumn(
        "segment",
        F.when(reaches["total_revenue"], SEGMENTS[0])
        .when(reaches["total_sessions"], SEGMENTS[1])
        .when(reaches["total_energy_kwh"], SEGMENTS[2])
        .otherwise(SEGMENTS[3]),
    ).drop("q")


def segment_summary(t: Tables, q: float = 0.75, flt: GlobalFilter = ALL) -> DataFrame:
    """Size, revenue, energy and mean sessions of each segment, with shares of the total."""
    summary = customer_segments(t, q, flt).groupBy("segment").agg(
        F.count("customer_id").alias("customers"),
        m.sum_units("total_revenue").alias("revenue_u"),
        m.sum_units("total_energy_kwh").alias("energy_u"),
        F.sum("total_sessions").alias("sessions"),
    )
    # At most four rows reach this window.
    whole = Window.partitionBy(F.lit(1))
    return summary.select(
        "segment",
        "customers",
        m.from_units("revenue_u").alias("total_revenue"),
        m.from_units("energy_u").alias("total_energy_kwh"),
        m.rate("sessions", "customers").alias("avg_sessions"),
        (m.rate("customers", F.sum("customers").over(whole)) * 100.0).alias("pct_of_customers"),
        (m.rate(m.from_units("revenue_u"), m.from_units(F.sum("revenue_u").over(whole))) * 100.0)
        .alias("pct_of_revenue"),
    )


def vehicle_intelligence(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """Totals and per-session averages of each vehicle type, most sessions first."""
    s = filtered_sessions(t, flt).filter(F.col("vehicle_type").isNotNull())
    totals = s.groupBy("vehicle_type").agg(
        F.count("session_id").alias("sessions"),
        m.exact_sum("energy_kwh").alias("energy_kwh"),
        m.exact_sum("revenue").alias("revenue"),
        m.sum_long("duration_minutes").alias("minutes"),
    )
    return totals.orderBy(F.col("sessions").desc(), "vehicle_type").select(
        "*",
        m.sql_rate("energy_kwh", "sessions").alias("avg_kwh_per_session"),
        m.sql_rate("minutes", "sessions").alias("avg_duration"),
        m.sql_rate("revenue", "sessions").alias("avg_revenue"),
    )
