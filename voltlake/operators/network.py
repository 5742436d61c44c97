"""Landing page, period metrics, health score, trends and station alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions import calendar as cal
from voltlake.functions import measures as m
from voltlake.plans.rollups import active_chargers, active_total
from voltlake.sources.filters import ALL, GlobalFilter, filtered_sessions, last_start, since
from voltlake.sources.tables import Tables

# The nine period metrics and whether more of each is better.
PERIOD_METRICS = {
    "total_sessions": True,
    "total_energy_kwh": True,
    "total_revenue": True,
    "avg_duration_minutes": True,
    "avg_energy_kwh": True,
    "failure_rate_pct": False,
    "utilization_pct": True,
    "active_stations": True,
    "active_chargers": True,
}


def landing_kpis(t: Tables) -> DataFrame:
    stations = t.stations.agg(F.count(F.lit(1)).alias("n")).scalar()
    return t.sessions.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        m.exact_sum("revenue").alias("total_revenue"),
        m.exact_sum("energy_kwh").alias("total_energy_kwh"),
    ).select(stations.alias("total_stations"), "total_sessions", "total_revenue", "total_energy_kwh")


def _trailing(t: Tables, days: int, flt: GlobalFilter) -> DataFrame:
    """Filtered sessions of the last ``days`` days before the last start: (last - days, last]."""
    s = filtered_sessions(t, flt)
    return since(s, cal.days_before(last_start(t, s, flt), days))


def _active_stations(t: Tables) -> Column:
    """Stations with an active charger, as a scalar subquery (semi join)."""
    return (
        t.stations.join(active_chargers(t.chargers), "station_id", "left_semi")
        .agg(F.count(F.lit(1)).alias("n"))
        .scalar()
    )


def period_metrics(t: Tables, days: int = 30, flt: GlobalFilter = ALL) -> DataFrame:
    """Nine metrics of the last ``days`` days and of as many days before: two rows, one scan."""
    s = filtered_sessions(t, flt)
    last = last_start(t, s, flt)
    split = cal.days_before(last, days)
    both = since(s, cal.days_before(last, 2 * days))
    both = both.withColumn("late", F.col("start_time") > split)
    # At most two groups; a window without sessions has none and is added as a row of zeros.
    volume = both.groupBy(F.when(F.col("late"), "current").otherwise("previous").alias("period")).agg(
        F.count(F.lit(1)).alias("rows"),
        m.sum_units("energy_kwh").alias("energy_u"),
        m.sum_units("revenue").alias("revenue_u"),
        m.sum_long("duration_minutes").alias("minutes"),
        F.expr("count_if(session_status = 'Completed' AND duration_minutes IS NOT NULL)").alias("completed_timed"),
        m.sum_long("duration_minutes", m.is_status("Completed")).alias("completed_minutes"),
        F.expr("count_if(session_status = 'Completed' AND energy_kwh IS NOT NULL)").alias("completed_metered"),
        m.sum_units("energy_kwh", m.is_status("Completed")).alias("completed_energy_u"),
        m.count_status("Failed").alias("failed"),
        F.min("start_time").alias("lo"),
        F.max("start_time").alias("hi"),
    )
    both_periods = t.sessions.sparkSession.range(1).select(F.expr("explode(array('current', 'previous'))").alias("period"))
    rows = both_periods.join(volume, "period", "left").na.fill(0)
    rows = (
        rows.withColumn("active_stations", _active_stations(t))
        .withColumn("active_chargers", active_total(t.chargers))
        .withColumn("period_days", cal.whole_days("lo", "hi", empty=days))
    )
    capacity_hours = F.col("active_chargers") * F.col("period_days") * 24
    return rows.select(
        "period",
        F.col("rows").alias("total_sessions"),
        m.from_units("energy_u").alias("total_energy_kwh"),
        m.from_units("revenue_u").alias("total_revenue"),
        m.rate("completed_minutes", "completed_timed").alias("avg_duration_minutes"),
        m.rate(m.from_units("completed_energy_u"), "completed_metered").alias("avg_energy_kwh"),
        (m.rate("failed", "rows") * 100.0).alias("failure_rate_pct"),
        (m.rate(F.col("minutes") / F.lit(60.0), capacity_hours) * 100.0).alias("utilization_pct"),
        "active_stations",
        "active_chargers",
    )


def period_comparison(t: Tables, days: int = 30, flt: GlobalFilter = ALL) -> DataFrame:
    """Change of each metric against the previous window, one row per metric."""
    p = period_metrics(t, days, flt)
    pairs = p.agg(*[
        F.struct(
            F.lit(name).alias("metric"),
            F.lit(better).alias("more_is_better"),
            F.max(F.when(F.col("period") == "current", F.col(name).cast("double"))).alias("current_value"),
            F.max(F.when(F.col("period") == "previous", F.col(name).cast("double"))).alias("previous_value"),
        ).alias(name)
        for name, better in PERIOD_METRICS.items()
    ]).select(F.explode(F.array(*PERIOD_METRICS)).alias("r")).select("r.*")
    change = m.rate(F.col("current_value") - F.col("previous_value"), "previous_value") * 100.0
    up, down = F.col("pct_change") > 0, F.col("pct_change") < 0
    return pairs.withColumn("pct_change", change).select(
        "metric", "current_value", "previous_value", "pct_change",
        F.when(up, "up").when(down, "down").otherwise("flat").alias("direction"),
        F.when(~up & ~down, "neutral")
        .when(up == F.col("more_is_better"), "good")
        .otherwise("bad")
        .alias("assessment"),
    )


def health_score(
    t: Tables,
    days: int = 30,
    fail_weight: float = 5,
    util_hi: float = 80,
    util_lo: float = 2,
    low_penalty: float = 5,
    flt: GlobalFilter = ALL,
) -> DataFrame:
    """100 minus penalties for failures, for utilization out of range and for offline chargers."""
    current = period_metrics(t, days, flt).filter(F.col("period") == "current")
    offline = t.chargers.agg(
        (m.rate(F.count_if(F.col("charger_status") == "Offline"), F.count(F.lit(1))) * 100.0).alias("pct")
    ).scalar()
    util = F.col("utilization_pct")
    penalties = current.select(
        "failure_rate_pct",
        "utilization_pct",
        (F.col("failure_rate_pct") * float(fail_weight)).alias("failure_penalty"),
        F.when(util > util_hi, util - float(util_hi))
        .when(util < util_lo, F.lit(float(low_penalty)))
        .otherwise(F.lit(0.0))
        .alias("utilization_penalty"),
        offline.alias("offline_penalty"),
    )
    score = F.greatest(
        F.lit(0.0),
        F.lit(100.0) - F.col("failure_penalty") - F.col("utilization_penalty") - F.col("offline_penalty"),
    )
    return penalties.withColumn("health_score", score).withColumn(
        "health_status",
        F.when(F.col("health_score") >= 90, "EXCELLENT")
        .when(F.col("health_score") >= 75, "FAIR")
        .otherwise("CRITICAL"),
    )


def daily_trend(t: Tables, days: int = 90, flt: GlobalFilter = ALL) -> DataFrame:
    """Revenue, energy, sessions and network utilization per date of the last ``days`` days."""
    s = filtered_sessions(t, flt)
    recent = since(s, cal.days_before(last_start(t, s, flt), days), inclusive=True)
    daily = recent.groupBy(cal.day().alias("date")).agg(
        m.exact_sum("revenue").alias("revenue"),
        m.exact_sum("energy_kwh").alias("energy_kwh"),
        F.count("session_id").alias("sessions"),
        m.sum_long("duration_minutes").alias("minutes"),
    )
    capacity = active_total(t.chargers) * m.MINUTES_PER_DAY
    return daily.withColumn("utilization_pct", m.open_rate("minutes", capacity) * 100.0).orderBy("date")


def sessions_by_hour(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """Session rows per hour of day; hours without sessions have no row."""
    s = filtered_sessions(t, flt).filter(F.col("start_time").isNotNull())
    return s.groupBy(cal.hour().alias("hour")).agg(F.count(F.lit(1)).alias("sessions")).orderBy("hour")


def sessions_by_dow(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """Session rows per weekday, Monday first."""
    s = filtered_sessions(t, flt).filter(F.col("start_time").isNotNull())
    counts = s.groupBy(cal.weekday_number(cal.day()).alias("n")).agg(F.count(F.lit(1)).alias("sessions"))
    return counts.orderBy("n").select(cal.weekday_name_of(F.col("n")).alias("day_of_week"), "sessions")


def station_30d(
    t: Tables, days: int = 30, zero_active: str = "inf", flt: GlobalFilter = ALL
) -> DataFrame:
    """Stations with a session in the last ``days`` days: volume, failure and utilization percent."""
    recent = _trailing(t, days, flt).filter(F.col("station_id").isNotNull())
    rollup = recent.groupBy("station_id").agg(
        F.count("session_id").alias("total_sessions"),
        m.count_status("Failed").alias("failed_sessions"),
        m.sum_long("duration_minutes").alias("minutes"),
    )
    active = F.coalesce(F.col("active_chargers"), F.lit(0))
    return (
        rollup.join(active_chargers(t.chargers), "station_id", "left")
        .withColumn("active_chargers", active)
        .select(
            "station_id", "total_sessions", "failed_sessions", "minutes", "active_chargers",
            (m.open_rate("failed_sessions", "total_sessions") * 100.0).alias("failure_rate_pct"),
            m.open_station_utilization("minutes", "active_chargers", F.lit(days), zero_active)
            .alias("utilization_pct"),
        )
    )


def _alert(t: Tables, hits: DataFrame, metric: str, n: int | None, by: str) -> DataFrame:
    """Name the stations and number the alerts in all. All come back; a caller may ask for the first ``n``."""
    named = hits.join(t.stations.select("station_id", "station_name"), "station_id")
    total = named.agg(F.count(F.lit(1)).alias("n")).scalar()
    order = {
        "station_id": [F.col("station_id")],
        "metric": [F.col(metric).desc(), F.col("station_id")],
        "metric_asc": [F.col(metric), F.col("station_id")],
    }[by]
    ranked = named.orderBy(*order)
    if n is not None:
        ranked = ranked.limit(n)
    return ranked.withColumn("total_alerts", total)


def alert_high_failure(
    t: Tables, pct: float = 3, n: int | None = None, by: str = "station_id", days: int = 30, flt: GlobalFilter = ALL
) -> DataFrame:
    """Stations failing above ``pct``; in station order unless ``by='metric'``."""
    hits = station_30d(t, days, flt=flt).filter(F.col("failure_rate_pct") > pct)
    return _alert(t, hits, "failure_rate_pct", n, by).select(
        "station_id", "station_name", "failure_rate_pct", "failed_sessions", "total_alerts"
    )


def alert_overloaded(
    t: Tables, pct: float = 15, n: int | None = None, by: str = "station_id", days: int = 30,
    zero_active: str = "inf", flt: GlobalFilter = ALL,
) -> DataFrame:
    """Stations utilized above ``pct``; used stations without active chargers are infinitely so."""
    hits = station_30d(t, days, zero_active, flt).filter(F.col("utilization_pct") > pct)
    return _alert(t, hits, "utilization_pct", n, by).select(
        "station_id", "station_name", "utilization_pct", "total_alerts"
    )


def alert_underutilized(
    t: Tables, pct: float = 1, n: int | None = None, by: str = "station_id", days: int = 30, flt: GlobalFilter = ALL
) -> DataFrame:
    """Stations with active chargers utilized below ``pct``."""
    hits = station_30d(t, days, flt=flt).filter((F.col("utilization_pct") < pct) & (F.col("active_chargers") > 0))
    return _alert(t, hits, "utilization_pct", n, "metric_asc" if by == "metric" else by).select(
        "station_id", "station_name", "utilization_pct", "active_chargers", "total_alerts"
    )


def alert_abnormal_chargers(
    t: Tables, days: int = 30, n: int | None = None, flt: GlobalFilter = ALL
) -> DataFrame:
    """Chargers by their abnormal sessions of the last ``days`` days, most first."""
    recent = _trailing(t, days, flt).filter(
        m.is_status("Abnormal") & F.col("station_id").isNotNull() & F.col("charger_id").isNotNull()
    )
    counts = recent.groupBy("station_id", "charger_id").agg(F.count(F.lit(1)).alias("incidents"))
    named = counts.join(t.stations.select("station_id", "station_name"), "station_id")
    # Reads the counts, so that both readers share one shuffle of them.
    total = named.agg(F.count_if(F.col("incidents") > 0).alias("n")).scalar()
    ranked = named.orderBy(F.col("incidents").desc(), "station_id", "charger_id")
    if n is not None:
        ranked = ranked.limit(n)
    return ranked.select(
        "station_id", "station_name", "charger_id", "incidents", total.alias("total_alerts")
    )
