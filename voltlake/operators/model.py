"""Enriched sessions, the filter as an operator, filter choices, table round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.functions import calendar as cal
from voltlake.plans.rollups import active_chargers
from voltlake.plans.skew import lookups
from voltlake.sources.filters import ALL, GlobalFilter, filtered_sessions
from voltlake.sources.tables import SESSION_COLUMNS, Tables


def _enrich(t: Tables, sessions: DataFrame) -> DataFrame:
    names = t.stations.select("station_id", "station_name", "city")
    types = t.chargers.select("charger_id", "charger_type")
    return (
        lookups(sessions, "session_id", (names, "station_id"), (types, "charger_id"))
        .select(
            *SESSION_COLUMNS,
            cal.day().alias("date"),
            cal.hour().alias("hour"),
            cal.weekday_name(cal.day()).alias("day_of_week"),
            cal.month_name(cal.day()).alias("month"),
            cal.is_weekend(cal.day()).alias("is_weekend"),
            "station_name",
            "city",
            "charger_type",
        )
    )


def enrich_sessions(t: Tables) -> DataFrame:
    """Sessions with calendar parts, station name, city and charger type."""
    return _enrich(t, t.sessions)


def global_filter(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """Enriched sessions that pass the filter; the filter is applied before the joins."""
    return _enrich(t, filtered_sessions(t, flt))


def filter_facets(t: Tables) -> DataFrame:
    """Choices of each filter as (facet, value), and the date bounds.

    One distinct over the session facets together (few groups per task) and one
    per dimension table; values come as text, ids included.
    """
    bounds = t.sessions.agg(
        F.to_date(F.min("start_time")).alias("lo"), F.to_date(F.max("start_time")).alias("hi")
    ).select(
        F.explode(F.array(
            F.struct(F.lit("date_min").alias("facet"), F.col("lo").cast("string").alias("value")),
            F.struct(F.lit("date_max").alias("facet"), F.col("hi").cast("string").alias("value")),
        )).alias("f")
    ).select("f.*")
    facets = [
        _facets(t.stations, {"city": "city", "station_id": "station"}),
        _facets(t.chargers, {"charger_type": "charger_type"}),
        _facets(t.sessions, {"vehicle_type": "vehicle_type", "session_status": "session_status"}),
    ]
    out = bounds
    for part in facets:
        out = out.unionByName(part)
    return out.filter(F.col("value").isNotNull()).orderBy("facet", "value")


def _facets(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    # The combinations are counted down first: explode then sees few rows.
    return (
        df.select(*columns).distinct()
        .select(F.explode(F.array(*[
            F.struct(F.lit(facet).alias("facet"), F.col(c).cast("string").alias("value"))
            for c, facet in columns.items()
        ])).alias("f"))
        .select("f.*")
        .distinct()
    )


def station_status(t: Tables) -> DataFrame:
    """Unknown, Online, Offline or Degraded for every station.

    Offline chargers do not degrade a station that has active ones; a charger
    under maintenance does.
    """
    flags = t.chargers.groupBy("station_id").agg(
        F.bool_or(F.col("charger_status") == "Active").alias("has_active"),
        F.bool_or(F.col("charger_status") == "Maintenance").alias("has_maintenance"),
    )
    active = F.coalesce(F.col("has_active"), F.lit(False))
    maintenance = F.coalesce(F.col("has_maintenance"), F.lit(False))
    known = flags.select(
        "station_id",
        F.when(~active, "Offline").when(~maintenance, "Online").otherwise("Degraded").alias("known_status"),
    )
    return (
        t.stations.select("station_id", "station_name")
        .join(known, "station_id", "left")
        .select("station_id", "station_name", F.coalesce("known_status", F.lit("Unknown")).alias("station_status"))
    )


def station_attribute_filter(
    t: Tables,
    city: str | None = None,
    area: str | None = None,
    station_type: str | None = None,
    status: str | None = None,
) -> DataFrame:
    """Stations by attribute and derived status, with their active chargers."""
    s = t.stations
    for column, wanted in (("city", city), ("area", area), ("station_type", station_type)):
        if wanted is not None:
            s = s.filter(F.col(column) == F.lit(wanted))
    state = station_status(t).select("station_id", "station_status")
    if status is not None:
        state = state.filter(F.col("station_status") == F.lit(status))
    return (
        s.join(state, "station_id")
        .join(active_chargers(t.chargers), "station_id", "left")
        .select(
            "station_id", "station_name", "city", "area", "station_type",
            F.col("total_chargers").cast("long").alias("total_chargers"),
            "station_status",
            F.coalesce("active_chargers", F.lit(0)).alias("active_chargers"),
        )
    )
