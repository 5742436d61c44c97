"""Pre-aggregations the operators start from.

Each one is a single pass over the fact. Spark combines before the shuffle, so a
station with a third of all sessions sends one row per task, like any other.
Dimension tables are joined to the aggregate; only what needs a row's own dimension joins the fact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions import calendar as cal
from voltlake.functions import measures as m

VOLUME = ("sessions", "revenue_u", "energy_u", "minutes", "failed", "completed")


def volume_measures() -> list[Column]:
    return [
        F.count("session_id").alias("sessions"),
        m.sum_units("revenue").alias("revenue_u"),
        m.sum_units("energy_kwh").alias("energy_u"),
        m.sum_long("duration_minutes").alias("minutes"),
        m.count_status("Failed").alias("failed"),
        m.count_status("Completed").alias("completed"),
    ]


def resum(*names: str) -> list[Column]:
    """Sum measures of a finer rollup."""
    return [F.sum(n).alias(n) for n in names]


@dataclass(frozen=True)
class Packed:
    """A rollup with all its measures in one array, which several readers share.

    A reader that needs one measure, or some keys, would else have a shuffle of its own: Spark drops unused
    measures, and moves conditions on keys, below the shuffle. The array holds the measures together, and an
    entry that is not deterministic keeps conditions above. All readers then name the same shuffle, and
    the fact is read once for all of them.
    """

    frame: DataFrame
    names: tuple[str, ...]

    def measure(self, name: str) -> Column:
        return F.col("measures")[self.names.index(name)]

    def sum(self, name: str) -> Column:
        return F.sum(self.measure(name))

    def exact(self, name: str) -> Column:
        """A measure of two parts (:func:`voltlake.functions.measures.parts`)."""
        return m.joined(self.measure(name), self.measure(f"{name}_rest"))

    def exact_sum(self, name: str) -> Column:
        return m.joined(self.sum(name), self.sum(f"{name}_rest"))

    def min(self, name: str) -> Column:
        return F.min(self.measure(name))

    def max(self, name: str) -> Column:
        return F.max(self.measure(name))


def packed(sessions: DataFrame, keys: Sequence[str], measures: Mapping[str, Column], *grains: Sequence[str]) -> Packed:
    """BIGINT measures per ``keys``, or at each of ``grains`` of the keys in one pass; ``grain`` then is the grain's number."""
    array = F.array(*[c.cast("long") for c in measures.values()], F.spark_partition_id().cast("long")).alias("measures")
    if not grains:
        return Packed(sessions.groupBy(*keys).agg(array), tuple(measures))
    # Copies of a row by explode: Spark numbers all columns of a GROUPING SETS anew in a second reader, and then
    # takes its shuffle for another one.
    types = {k: sessions.schema[k].dataType for k in keys}
    copies = F.explode(F.array(*[
        F.struct(F.lit(i).alias("grain"), *[(F.col(k) if k in grain else F.lit(None)).cast(types[k]).alias(k) for k in keys])
        for i, grain in enumerate(grains)
    ])).alias("_key")
    by = [F.col(f"_key.{k}").alias(k) for k in ("grain", *keys)]
    return Packed(sessions.select("*", copies).groupBy(*by).agg(array), tuple(measures))


def station_rollup(sessions: DataFrame) -> DataFrame:
    """Volume per station; sessions without a station are in no group."""
    return (
        sessions.filter(F.col("station_id").isNotNull()).groupBy("station_id").agg(*volume_measures())
    )


def station_profile_rollup(sessions: DataFrame, by_date: bool) -> DataFrame:
    """Volume per station with its hourly and, on request, daily extremes.

    The hourly counts (and the daily ones, as a second grouping set of the same
    scan) are combined to one row per station: ``busiest`` and ``mean_hour`` over
    the observed hours, ``busiest_hour``, ``busiest_day`` and ``peak_day_minutes``.
    """
    base = sessions.filter(F.col("station_id").isNotNull()).select(
        "station_id", "session_id", "revenue", "energy_kwh", "duration_minutes", "session_status",
        cal.hour().alias("hour"), cal.day().alias("date"),
    )
    rows = F.count(F.lit(1)).alias("rows")
    if by_date:
        base = base.groupingSets(
            [["station_id", "hour"], ["station_id", "date"]], "station_id", "hour", "date"
        ).agg(F.grouping("date").alias("hourly"), rows, *volume_measures())
    else:
        base = base.groupBy("station_id", "hour").agg(F.lit(1).alias("hourly"), rows, *volume_measures())
    hourly = F.col("hourly") == 1
    totals = [F.sum(F.when(hourly, F.col(n))).alias(n) for n in ("rows", *VOLUME)]
    hours = [
        F.max(F.when(hourly, F.col("rows"))).alias("busiest"),
        F.count_if(hourly & F.col("hour").isNotNull()).alias("hours"),
        F.sum(F.when(hourly & F.col("hour").isNotNull(), F.col("rows"))).alias("hour_rows"),
    ]
    if not by_date:
        return _with_mean_hour(base.groupBy("station_id").agg(*totals, *hours))
    daily = (F.col("hourly") == 0) & F.col("date").isNotNull()
    per_weekday = [
        F.sum(F.when(daily & (cal.weekday_number("date") == i), F.col("rows"))).alias(f"weekday_{i}")
        for i in range(7)
    ]
    out = base.groupBy("station_id").agg(
        *totals,
        *hours,
        F.min(
            F.when(hourly & F.col("hour").isNotNull(), F.struct((-F.col("rows")).alias("n"), F.col("hour")))
        ).alias("top_hour"),
        F.max(F.when(daily, F.col("minutes"))).alias("peak_day_minutes"),
        *per_weekday,
    )
    by_name = F.array(*[
        F.when(F.col(f"weekday_{i}").isNotNull(), F.struct((-F.col(f"weekday_{i}")).alias("n"), F.lit(name).alias("day")))
        for i, name in enumerate(cal.WEEKDAYS)
    ])
    return _with_mean_hour(out).select(
        "station_id", "rows", *VOLUME, "busiest", "mean_hour", "peak_day_minutes",
        F.col("top_hour.hour").alias("busiest_hour"),
        F.array_min(by_name)["day"].alias("busiest_day"),
    )


def _with_mean_hour(df: DataFrame) -> DataFrame:
    return df.withColumn("mean_hour", m.sql_rate("hour_rows", "hours")).drop("hours", "hour_rows")


def hourly_rollup(sessions: DataFrame) -> DataFrame:
    """Volume per hour of day: at most 24 rows."""
    s = sessions.filter(F.col("start_time").isNotNull()).withColumn("hour", cal.hour())
    return s.groupBy("hour").agg(
        F.count(F.lit(1)).alias("rows"), F.count("duration_minutes").alias("timed"), *volume_measures()
    )


def active_chargers(chargers: DataFrame) -> DataFrame:
    """(station_id, active_chargers) of stations that have an active charger."""
    return (
        chargers.filter((F.col("charger_status") == "Active") & F.col("station_id").isNotNull())
        .groupBy("station_id")
        .agg(F.count(F.lit(1)).alias("active_chargers"))
    )


def active_total(chargers: DataFrame) -> Column:
    """Number of active chargers in the network, as a scalar subquery."""
    return chargers.agg(F.count_if(F.col("charger_status") == "Active").alias("n")).scalar()


def first_by(metric: Column, *keys: str) -> Column:
    """Aggregate: the row with the largest metric, the smallest key on a tie; NULL keys do not count.

    A MIN over (-metric, keys): combined map-side, no sort and no window. The
    NULL test is part of the aggregate, not a filter: a filter on a group key
    would move below the group's shuffle and keep others from sharing it.
    """
    return F.min(F.when(F.col(keys[0]).isNotNull(), F.struct((-metric).alias("n"), *[F.col(k) for k in keys])))


def sorted_once(df: DataFrame, *order: Column | str) -> DataFrame:
    """A global sort that does not run its input twice.

    Spark samples the input of a sort for the range bounds, which would repeat a
    scan of the fact. The few rows found are exchanged first; sampling reads those.
    """
    return df.hint("rebalance").orderBy(*order)
