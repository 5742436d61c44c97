"""Demand by time of day, weekday, vehicle and month; statistical peak windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions import calendar as cal
from voltlake.functions import measures as m
from voltlake.plans.rollups import active_total, first_by, hourly_rollup
from voltlake.sources.filters import ALL, GlobalFilter, filtered_sessions
from voltlake.sources.tables import Tables


def demand_kpis(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """Peak hour, weekday, station and city, and mean sessions per elapsed hour.

    One pass counts by (station, weekday, hour); the four maxima are read from
    those counts. On a tie the smallest key wins (weekdays by name).
    """
    s = filtered_sessions(t, flt)
    base = s.groupBy(
        "station_id", cal.weekday_number(cal.day()).alias("weekday"), cal.hour().alias("hour")
    ).agg(F.count(F.lit(1)).alias("n"))

    def top(key: Column, df: DataFrame = base) -> Column:
        counts = df.select(key.alias("k"), "n").groupBy("k").agg(F.sum("n").alias("n"))
        return counts.agg(first_by(F.col("n"), "k").alias("top")).select("top.k").scalar()

    by_station = base.groupBy("station_id").agg(F.sum("n").alias("n"))
    in_city = by_station.join(t.stations.select("station_id", "city"), "station_id", "left")
    station = top(F.col("station_id")) if flt.station_id is None else F.lit(flt.station_id)
    return base.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_sessions")).select(
        top(F.col("hour")).alias("peak_hour"),
        top(cal.weekday_name_of(F.col("weekday"))).alias("peak_day"),
        station.alias("peak_station"),
        top(F.col("city"), in_city).alias("peak_city"),
        "total_sessions",
        (F.col("total_sessions") / cal.elapsed_hours(s)).alias("avg_sessions_per_hour"),
    )


def _flagged_hours(hourly: DataFrame, k_sd: float) -> DataFrame:
    """Hours with mean, sample deviation, threshold and peak flag.

    Over the observed hours. One observed hour has no deviation and so no peak.
    """
    # At most 24 rows reach this window.
    whole = Window.partitionBy(F.lit(1))
    return hourly.withColumns({
        "mean_volume": F.avg("rows").over(whole), "sd_volume": F.stddev_samp("rows").over(whole),
    }).withColumn("threshold", F.col("mean_volume") + F.lit(float(k_sd)) * F.col("sd_volume")).withColumn("is_peak", F.coalesce(F.col("rows") > F.col("threshold"), F.lit(False)))


def peak_hours(t: Tables, k_sd: float = 1, flt: GlobalFilter = ALL) -> DataFrame:
    """Hours with more sessions than mean + ``k_sd`` standard deviations."""
    flagged = _flagged_hours(hourly_rollup(filtered_sessions(t, flt)), k_sd)
    return flagged.filter("is_peak").orderBy("hour").select(
        "hour", F.col("rows").alias("sessions"),
        F.round("mean_volume", 6).alias("mean_volume"),
        F.round("sd_volume", 6).alias("sd_volume"),
        F.round("threshold", 6).alias("threshold"),
    )


def peak_windows(t: Tables, k_sd: float = 1, flt: GlobalFilter = ALL) -> DataFrame:
    """Consecutive peak hours merged to [start, end); midnight does not wrap."""
    hours = _flagged_hours(hourly_rollup(filtered_sessions(t, flt)), k_sd).filter("is_peak")
    # At most 24 rows reach this window.
    island = F.col("hour") - F.row_number().over(Window.orderBy("hour"))
    return (
        hours.withColumn("island", island)
        .groupBy("island")
        .agg(
            F.min("hour").alias("start_hour"),
            (F.max("hour") + 1).alias("end_hour"),
            F.sum("rows").alias("sessions"),
        )
        .orderBy("start_hour")
        .select("start_hour", "end_hour", "sessions")
    )


def demand_heatmap(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """Session rows per weekday and hour, Monday first."""
    s = filtered_sessions(t, flt).filter(F.col("start_time").isNotNull())
    counts = s.groupBy(cal.weekday_number(cal.day()).alias("n"), cal.hour().alias("hour")).agg(
        F.count(F.lit(1)).alias("sessions")
    )
    return counts.orderBy("n", "hour").select(
        cal.weekday_name_of(F.col("n")).alias("day_of_week"), "hour", "sessions"
    )


def weekday_weekend(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    s = filtered_sessions(t, flt).filter(F.col("start_time").isNotNull())
    label = F.when(cal.is_weekend(cal.day()), "Weekend").otherwise("Weekday")
    return s.groupBy(label.alias("day_type")).agg(F.count(F.lit(1)).alias("sessions"))


def vehicle_demand(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """Session rows per vehicle type, fewest first."""
    s = filtered_sessions(t, flt).filter(F.col("vehicle_type").isNotNull())
    return s.groupBy("vehicle_type").agg(F.count(F.lit(1)).alias("sessions")).orderBy("sessions", "vehicle_type")


def monthly_demand(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """Session rows per calendar month, as yyyy-MM."""
    s = filtered_sessions(t, flt).filter(F.col("start_time").isNotNull())
    counts = s.groupBy(F.trunc(cal.day(), "month").alias("first_day")).agg(
        F.count(F.lit(1)).alias("sessions")
    )
    return counts.orderBy("first_day").select(
        F.date_format("first_day", "yyyy-MM").alias("month"), "sessions"
    )


def peak_vs_offpeak(t: Tables, k_sd: float = 1, flt: GlobalFilter = ALL) -> DataFrame:
    """Volume, mean duration and utilization inside and outside the peak hours.

    Read from the hourly rollup: the fact is aggregated to 24 rows once. The
    capacity of a side is active chargers x days x its hours per day; with a
    station filter the active chargers are that station's.
    """
    s = filtered_sessions(t, flt)
    flagged = _flagged_hours(hourly_rollup(s), k_sd)
    sides = ("Peak", F.col("is_peak")), ("Off-Peak", ~F.col("is_peak"))
    wide = flagged.agg(
        F.count_if("is_peak").alias("peak_hours"),
        F.array(*[
            F.struct(
                F.lit(name).alias("window"),
                *[
                    F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0)).alias(c)
                    for c in ("rows", "energy_u", "revenue_u", "minutes", "timed")
                ],
            )
            for name, side in sides
        ]).alias("sides"),
    )
    chargers = t.chargers
    if flt.station_id is not None:
        chargers = chargers.filter(F.col("station_id") == F.lit(flt.station_id))
    active = F.greatest(active_total(chargers), F.lit(1))
    hours = F.when(F.col("window") == "Peak", F.col("peak_hours")).otherwise(24 - F.col("peak_hours"))
    capacity = active * cal.date_span(s) * hours * 60
    return wide.select("peak_hours", F.explode("sides").alias("s")).select("peak_hours", "s.*").select(
        "window",
        F.col("rows").alias("sessions"),
        m.from_units("energy_u").alias("energy_kwh"),
        m.from_units("revenue_u").alias("revenue"),
        (m.rate("minutes", capacity) * 100.0).alias("utilization_pct"),
        m.rate("minutes", "timed").alias("avg_duration_minutes"),
    )
