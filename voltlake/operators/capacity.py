"""Capacity baseline and what-if projections, for all stations at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions import calendar as cal
from voltlake.functions import measures as m
from voltlake.operators.station import pressure_index, pressure_parts
from voltlake.plans.rollups import VOLUME, active_chargers, station_profile_rollup
from voltlake.sources.filters import ALL, GlobalFilter, filtered_sessions
from voltlake.sources.tables import Tables

BASELINE = (
    "station_id", "station_name", "chargers", "utilization_pct", "peak_day_utilization_pct",
    "queue_proxy", "sessions_per_charger", "failure_rate_pct", "revenue_capacity", "cpi",
)


def _measured(t: Tables, flt: GlobalFilter) -> DataFrame:
    s = filtered_sessions(t, flt)
    out = t.stations.select("station_id", "station_name")
    out = out.join(station_profile_rollup(s, by_date=True), "station_id", "left")
    out = out.join(active_chargers(t.chargers), "station_id", "left")
    out = out.na.fill(0, subset=[*VOLUME, "busiest", "peak_day_minutes", "active_chargers"])
    return out.withColumns({
        "chargers": F.greatest(F.lit(1), F.col("active_chargers")),
        "days": cal.elapsed_days(s),
        "peak_ratio": m.rate("busiest", "mean_hour"),
        "failure_rate_pct": m.rate("failed", "sessions") * 100.0,
    })


def _projection(chargers: Column) -> dict[str, Column]:
    """The figures that depend on the number of chargers, demand held constant.

    There is no guard for stations without sessions: their peak ratio is 0.
    """
    util = m.rate("minutes", chargers * F.col("days") * m.MINUTES_PER_DAY) * 100.0
    queue = m.rate("sessions", chargers * F.col("days"))
    parts = pressure_parts(util, F.col("peak_ratio"), queue, F.col("failure_rate_pct"))
    return {
        "utilization_pct": util,
        "peak_day_utilization_pct": m.rate("peak_day_minutes", chargers * m.MINUTES_PER_DAY) * 100.0,
        "queue_proxy": queue,
        "sessions_per_charger": m.rate("sessions", chargers),
        "cpi": m.as_long(pressure_index(parts)),
    }


def _baseline(t: Tables, flt: GlobalFilter) -> DataFrame:
    out = _measured(t, flt).withColumns(_projection(F.col("chargers")))
    util = F.col("utilization_pct")
    capacity = F.when(util > 0, m.rate(m.from_units("revenue_u"), util / F.lit(100.0))).otherwise(F.lit(0.0))
    return out.withColumn("revenue_capacity", capacity)


def capacity_baseline(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """Load, peak load, turnover, revenue capacity and index of every station as it is."""
    return _baseline(t, flt).select(*BASELINE)


def capacity_scenarios(
    t: Tables, add: Sequence[int] = (1, 2, 3, 4, 5), station_ids: DataFrame | Sequence | None = None,
    flt: GlobalFilter = ALL,
) -> DataFrame:
    """The baseline recomputed with ``add`` more chargers, one row per station and number.

    ``station_ids`` restricts the stations: a sequence, or a DataFrame with a
    station_id column for long lists.
    """
    base = _baseline(t, flt)
    if isinstance(station_ids, DataFrame):
        base = base.join(station_ids.select("station_id").distinct(), "station_id", "left_semi")
    elif station_ids is not None:
        base = base.filter(F.col("station_id").isin(list(station_ids)))
    rows = base.withColumn("added", F.explode(F.array(*[F.lit(int(n)).cast("long") for n in add])))
    more = F.col("chargers") + F.col("added")
    scenario = _projection(more)
    scenario["revenue_capacity"] = F.col("revenue_capacity") * m.rate(more, "chargers")
    return rows.select(
        "station_id", "station_name", "added",
        more.alias("scenario_chargers"),
        *[c.alias(f"scenario_{name}") for name, c in scenario.items()],
        *[(c - F.col(name)).alias(f"{name}_change") for name, c in scenario.items()],
    )
