"""The operations-center model: sessions over slots, z-scores, expansion candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions import calendar as cal
from voltlake.functions import measures as m
from voltlake.operators.model import station_status
from voltlake.sources.filters import ALL, GlobalFilter, filtered_sessions
from voltlake.sources.tables import Tables


def noc_stations(t: Tables) -> DataFrame:
    """Stations in this model's terms: position, charger count, status."""
    places = t.stations.select(
        "station_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
        F.col("total_chargers").cast("long").alias("chargers_count"),
    )
    return places.join(
        station_status(t).select("station_id", F.col("station_status").alias("status")), "station_id"
    )


def noc_sessions(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """Sessions in this model's terms: hours instead of minutes."""
    return filtered_sessions(t, flt).select(
        "session_id", "station_id", "start_time",
        cal.weekday_name(cal.day()).alias("day_of_week"),
        cal.hour().alias("hour_of_day"),
        (F.col("duration_minutes") / F.lit(60.0)).alias("duration_hrs"),
        "energy_kwh", "revenue",
    )


def noc_station_filter(
    t: Tables, station_ids: DataFrame | Sequence = (), flt: GlobalFilter = ALL
) -> DataFrame:
    """Sessions of several stations; none selected means all.

    A DataFrame with a station_id column is a semi join, for long lists.
    """
    s = noc_sessions(t, flt)
    if isinstance(station_ids, DataFrame):
        return s.join(station_ids.select("station_id"), "station_id", "left_semi").select(*s.columns)
    chosen = list(station_ids)
    return s.filter(F.col("station_id").isin(chosen)) if chosen else s


def noc_kpis(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """Sessions, energy in MWh, revenue, and stations online out of all."""
    stations = noc_stations(t).agg(F.struct(
        F.count_if(F.col("status") == "Online").alias("online"), F.count(F.lit(1)).alias("all")
    ).alias("s")).scalar()
    totals = filtered_sessions(t, flt).agg(
        F.count(F.lit(1)).alias("total_sessions"),
        m.exact_sum("energy_kwh").alias("energy_kwh"),
        m.exact_sum("revenue").alias("total_revenue"),
    ).withColumn("s", stations)
    return totals.select(
        "total_sessions",
        (F.col("energy_kwh") / F.lit(1000.0)).alias("energy_mwh"),
        "total_revenue",
        F.col("s.online").alias("online_stations"),
        F.col("s.all").alias("total_stations"),
    )


def noc_daily_energy(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """Energy per calendar day from first to last; days without sessions are 0."""
    s = filtered_sessions(t, flt)
    daily = s.groupBy(cal.day().alias("date")).agg(m.exact_sum("energy_kwh").alias("energy"))
    bounds = s.agg(F.to_date(F.min("start_time")).alias("lo"), F.to_date(F.max("start_time")).alias("hi"))
    calendar = bounds.filter(F.col("lo").isNotNull()).select(
        F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("date")
    )
    return (
        calendar.join(daily, "date", "left")
        .select("date", F.coalesce("energy", F.lit(0.0)).alias("energy_kwh"))
        .orderBy("date")
    )


def noc_station_health(
    t: Tables, days: int = 30, hi: float = 60, lo: float = 5, flt: GlobalFilter = ALL
) -> DataFrame:
    """Utilization over one-hour slots and a health category; an offline station is always critical."""
    counts = filtered_sessions(t, flt).filter(F.col("station_id").isNotNull()).groupBy("station_id").agg(
        F.count("session_id").alias("total_sessions"), m.sum_units("energy_kwh").alias("energy_u")
    )
    out = noc_stations(t).join(counts, "station_id", "left").na.fill(0, subset=["total_sessions", "energy_u"])
    out = out.withColumn("utilization_pct", m.slot_utilization("total_sessions", "chargers_count", days))
    util = F.col("utilization_pct")
    return out.select(
        "station_id", "lat", "lon", "status", "chargers_count", "total_sessions",
        m.from_units("energy_u").alias("total_energy_kwh"),
        "utilization_pct",
        F.when(F.col("status") == "Offline", "Critical (Offline)")
        .when(util > hi, "Overloaded")
        .when(util < lo, "Underutilized")
        .when(F.col("status") == "Degraded", "Risky (Degraded)")
        .otherwise("Healthy")
        .alias("health_category"),
    )


def _exact_sums(name: str, whole: Column) -> list[Column]:
    """Count, sum and sum of squares of a column of whole numbers."""
    square = (whole.cast("decimal(19,0)") * whole.cast("decimal(19,0)")).cast("decimal(38,0)")
    return [
        F.count(whole).cast("decimal(19,0)").alias(f"n_{name}"),
        F.sum(whole.cast("decimal(20,0)")).cast("decimal(28,0)").alias(f"sum_{name}"),
        F.sum(square).cast("decimal(38,0)").alias(f"squares_{name}"),
    ]


def _moments(sums: DataFrame, names: dict[str, float]) -> DataFrame:
    """One row: mean and sample deviation of each column, whose whole numbers are its values times a scale.

    With the whole part q of the mean and the rest r = sum - q * n, the squared distances from q add up to
    squares - q * (sum + r), and those from the mean to that less r * r / n. As a square of a whole number is not
    less than the number, this is a whole number (that sum less r) and r * (n - r) / n, neither below 0: nothing
    cancels, however small the spread is beside the mean.
    """
    for name in names:
        n, total, squares = f"n_{name}", f"sum_{name}", f"squares_{name}"
        sums = sums.withColumn("q", F.expr(f"CAST({total} div {n} - CASE WHEN {total} % {n} < 0 THEN 1 ELSE 0 END AS DECIMAL(19,0))"))
        sums = sums.withColumn("r", F.expr(f"CAST({total} - q * {n} AS DECIMAL(19,0))"))
        scale = f"{float(names[name])!r}D"
        spread = f"CAST({squares} - q * ({total} + r) - r AS DOUBLE) + CAST(r AS DOUBLE) * (CAST({n} - r AS DOUBLE) / CAST({n} AS DOUBLE))"
        sums = sums.withColumns({
            f"mean_{name}": F.expr(f"(CAST(q AS DOUBLE) + CAST(r AS DOUBLE) / CAST({n} AS DOUBLE)) / {scale}"),
            f"sd_{name}": F.expr(f"CASE WHEN {n} > 1 THEN sqrt(({spread}) / CAST({n} - 1 AS DOUBLE)) / {scale} END"),
        })
    return sums


def noc_zscore_behavior(
    t: Tables, camper: tuple[float, float] = (2, -1), fault: tuple[float, float] = (-0.5, 2.5),
    flt: GlobalFilter = ALL,
) -> DataFrame:
    """Every session with its z-scores and behaviour; the fault rule wins.

    Mean and sample deviation of the whole set come as one scalar row, not from a
    window over the set: from the count, the exact sum and the exact sum of squares in
    minutes and hundred-millionths, without a difference of rounded numbers.
    """
    s = noc_sessions(t, flt)
    sums = s.agg(
        *_exact_sums("duration_hrs", F.rint(F.col("duration_hrs") * 60.0).cast("long")),
        *_exact_sums("energy_kwh", m.fine_units("energy_kwh")),
    )
    names = {"duration_hrs": 60.0, "energy_kwh": float(m.FINE)}
    # no value: the divisor is NULL, and so is all else
    sums = sums.withColumns({f"n_{k}": F.expr(f"nullif(n_{k}, 0)") for k in names})
    stats = _moments(sums, names).select(F.struct(*[f"{part}_{k}" for part in ("mean", "sd") for k in names]).alias("s")).scalar()

    def z(c: str):
        return F.try_divide(F.col(c) - F.col(f"s.mean_{c}"), F.col(f"s.sd_{c}"))

    scored = s.withColumn("s", stats).withColumns({"duration_z": z("duration_hrs"), "energy_z": z("energy_kwh")})
    is_fault = (F.col("duration_z") < fault[0]) & (F.col("energy_z") > fault[1])
    is_camper = (F.col("duration_z") > camper[0]) & (F.col("energy_z") < camper[1])
    return scored.select(
        "session_id", "station_id", "start_time", "duration_hrs", "energy_kwh",
        F.round("duration_z", 6).alias("duration_z"),
        F.round("energy_z", 6).alias("energy_z"),
        F.when(is_fault, "Hardware Fault Risk").when(is_camper, "Camper Detected").otherwise("Normal")
        .alias("behavior"),
    )


def noc_expansion(t: Tables, days: int = 30, hi: float = 60, flt: GlobalFilter = ALL) -> DataFrame:
    """Overloaded stations, most utilized first."""
    hits = noc_station_health(t, days, hi, flt=flt).filter(F.col("health_category") == "Overloaded")
    return hits.orderBy(F.col("utilization_pct").desc(), "station_id").select(
        "station_id", "chargers_count", "total_sessions", "utilization_pct"
    )
