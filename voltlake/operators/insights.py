"""Six rule-based findings about the network.

A finding is a row (number, name, subject, value, baseline, support, sentence);
a rule that does not fire gives no row. All findings read one rollup by station and hour, which is
one pass over the fact; stations, hours and the network are sums of its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions import calendar as cal
from voltlake.functions import measures as m
from voltlake.functions.quantiles import top_share
from voltlake.plans.rollups import Packed, active_chargers, first_by, packed
from voltlake.sources.filters import ALL, GlobalFilter, filtered_sessions
from voltlake.sources.tables import Tables

CAMPER_MINUTES = 240
CAMPER_KWH = 2


@dataclass(frozen=True)
class _Rollup:
    """The tables and the one rollup that the findings read."""

    t: Tables
    volume: Packed

    def days(self) -> Column:
        span = self.volume.frame.agg((self.volume.max("last_day") - self.volume.min("first_day")).alias("days"))
        return span.select(F.greatest(F.coalesce("days", F.lit(1)), F.lit(1)).cast("long").alias("days")).scalar()

    def stations(self, zero_active: str = "inf") -> DataFrame:
        """Stations that had sessions, with utilization and failure percent.

        Without active chargers utilization is infinite, and so is then the mean
        over the stations; ``zero_active='exclude'`` leaves such stations out of both.
        """
        v = self.volume
        totals = v.frame.filter(F.col("station_id").isNotNull()).groupBy("station_id").agg(
            v.sum("sessions").alias("total_sessions"), v.exact_sum("revenue_u").alias("revenue_u"),
            v.sum("minutes").alias("minutes"), v.sum("failed").alias("failed"),
        )
        active = F.coalesce(F.col("active_chargers"), F.lit(0))
        return (
            totals.join(active_chargers(self.t.chargers), "station_id", "left")
            .withColumn("active_chargers", active)
            .join(self.t.stations.select("station_id", "station_name"), "station_id", "left")
            .withColumns({
                "utilization": m.open_station_utilization("minutes", "active_chargers", self.days(), zero_active),
                "failure": m.sql_rate("failed", "total_sessions") * 100.0,
            })
        )


def _rollup(t: Tables, flt: GlobalFilter, minutes: int = CAMPER_MINUTES, kwh: float = CAMPER_KWH) -> _Rollup:
    sessions = filtered_sessions(t, flt).withColumns({"hour": cal.hour(), "date": cal.day()})
    camper = (F.col("duration_minutes") > minutes) & (F.col("energy_kwh") < float(kwh))
    return _Rollup(t, packed(sessions, ["station_id", "hour"], {
        "rows": F.count(F.lit(1)),
        "sessions": F.count("session_id"),
        **m.parts("revenue_u", "revenue"),
        "minutes": m.sum_long("duration_minutes"),
        "failed": m.count_status("Failed"),
        "campers": F.count_if(camper),
        "first_day": F.min(F.unix_date("date")),
        "last_day": F.max(F.unix_date("date")),
    }))


def _text(value: Column, digits: int = 1) -> Column:
    """A number with fixed decimals, half up; infinity as a word."""
    finite = F.when(F.abs(value) < 1e18, value).cast(f"decimal(28,{digits})").cast("string")
    return F.coalesce(finite, F.lit("infinite"))


def _finding(
    df: DataFrame, number: int, name: str, subject: Column, value: Column, baseline: Column,
    support: Column, *sentence: Column | str,
) -> DataFrame:
    words = [F.lit(w) if isinstance(w, str) else w for w in sentence]
    return df.select(
        F.lit(number).cast("long").alias("insight_id"),
        F.lit(name).alias("insight"),
        subject.cast("string").alias("subject"),
        F.round(value.cast("double"), 6).alias("value"),
        F.round(baseline.cast("double"), 6).alias("baseline"),
        support.cast("long").alias("support"),
        F.concat(*words).alias("sentence"),
    )


def _capacity_pressure(r: _Rollup, ratio: float = 1.5, zero_active: str = "inf") -> DataFrame:
    s = r.stations(zero_active)
    known = s.filter(F.col("utilization").isNotNull())
    # MAX over (value, -key order): largest utilization, smallest station on a tie.
    top = known.agg(first_by(F.col("utilization"), "station_id").alias("top"), F.avg("utilization").alias("mean"))
    top = top.select(F.col("top.station_id").alias("station_id"), (-F.col("top.n")).alias("utilization"), "mean")
    hit = top.filter(F.col("utilization") > F.col("mean") * float(ratio))
    hit = hit.join(r.t.stations.select("station_id", "station_name"), "station_id", "left")
    return _finding(
        hit, 1, "Capacity pressure", F.col("station_name"), F.col("utilization"), F.col("mean"), F.lit(1),
        F.coalesce("station_name", F.lit("?")), " runs at ", _text(F.col("utilization")),
        "% utilization; the network mean is ", _text(F.col("mean")), "%.",
    )


def _revenue_concentration(r: _Rollup, top: float = 0.10, pct: float = 15) -> DataFrame:
    per_station = r.volume.frame.filter(F.col("station_id").isNotNull()).groupBy("station_id").agg(
        (r.volume.sum("revenue_u") * m.SCALE + r.volume.sum("revenue_u_rest")).cast("decimal(19,0)").alias("revenue_f")
    )
    share = top_share(per_station, "revenue_f", top).select(
        "*", (m.rate("top_sum", "total_sum") * 100.0).alias("share")
    )
    hit = share.filter((F.col("total_sum") > 0) & (F.col("share") > float(pct)))
    return _finding(
        hit, 2, "Revenue concentration", F.lit(None), F.col("share"), F.lit(float(top) * 100.0),
        F.col("top_count"),
        "The top ", F.col("top_count").cast("string"), " stations earn ", _text(F.col("share")),
        "% of all revenue (", _text(m.from_units(F.col("top_sum") * F.expr("0.00000001BD")), 0), ").",
    )


def _failure(r: _Rollup, pct: float = 3, ratio: float = 2) -> DataFrame:
    s = r.stations().filter(F.col("failure").isNotNull())
    order = F.struct(
        (-F.col("failure")).alias("n"), (-F.col("revenue_u")).alias("r"), F.col("station_id"),
        F.col("station_name"), F.col("total_sessions"),
    )
    worst = s.agg(F.min(order).alias("w"), F.avg("failure").alias("mean")).select(
        "w.station_name", "w.total_sessions", (-F.col("w.n")).alias("failure"), "mean"
    )
    hit = worst.filter((F.col("failure") > float(pct)) & (F.col("failure") > F.col("mean") * float(ratio)))
    return _finding(
        hit, 3, "Failure rate", F.col("station_name"), F.col("failure"), F.col("mean"), F.col("total_sessions"),
        F.coalesce("station_name", F.lit("?")), " fails in ", _text(F.col("failure")), "% of ",
        F.col("total_sessions").cast("string"), " sessions; the network mean is ", _text(F.col("mean")), "%.",
    )


def _underutilized(r: _Rollup, util: float = 2, mean: float = 5, zero_active: str = "inf") -> DataFrame:
    s = r.stations(zero_active)
    order = F.struct(F.col("utilization").alias("u"), F.col("station_id"), F.col("station_name"))
    low = s.agg(
        F.min(F.when((F.col("active_chargers") > 0) & F.col("utilization").isNotNull(), order)).alias("l"),
        F.avg("utilization").alias("mean"),
    ).select(F.col("l.u").alias("utilization"), "l.station_name", "mean")
    hit = low.filter((F.col("utilization") < float(util)) & (F.col("mean") > float(mean)))
    return _finding(
        hit, 4, "Underutilization", F.col("station_name"), F.col("utilization"), F.col("mean"), F.lit(1),
        F.coalesce("station_name", F.lit("?")), " is used at only ", _text(F.col("utilization")),
        "%; the network mean is ", _text(F.col("mean")), "%.",
    )


def _peak_hour(r: _Rollup, ratio: float = 1.3) -> DataFrame:
    hourly = r.volume.frame.filter(F.col("hour").isNotNull()).groupBy("hour").agg(r.volume.sum("rows").alias("n"))
    peak = hourly.agg(first_by(F.col("n"), "hour").alias("top"), F.avg("n").alias("mean")).select(
        "top.hour", (-F.col("top.n")).alias("sessions"), m.rate(-F.col("top.n"), "mean").alias("ratio")
    )
    hit = peak.filter(F.col("ratio") > float(ratio))
    return _finding(
        hit, 5, "Peak hour", F.col("hour"), F.col("ratio"), F.lit(float(ratio)), F.col("sessions"),
        "Demand peaks at ", F.col("hour").cast("string"), ":00 with ", _text(F.col("ratio")),
        " times the mean hourly sessions.",
    )


def _campers(r: _Rollup, minutes: int = CAMPER_MINUTES, kwh: float = CAMPER_KWH, min_count: int = 50) -> DataFrame:
    hit = r.volume.frame.agg(r.volume.sum("campers").alias("n")).filter(F.col("n") > min_count)
    return _finding(
        hit, 6, "Campers", F.lit(None), F.col("n"), F.lit(min_count), F.col("n"),
        F.col("n").cast("string"), f" sessions held a charger for more than {minutes} minutes and drew less than ",
        _text(F.lit(float(kwh))), " kWh.",
    )


def insight_capacity_pressure(
    t: Tables, ratio: float = 1.5, zero_active: str = "inf", flt: GlobalFilter = ALL
) -> DataFrame:
    """The station of highest utilization, if above ``ratio`` times the mean."""
    return _capacity_pressure(_rollup(t, flt), ratio, zero_active)


def insight_revenue_concentration(
    t: Tables, top: float = 0.10, pct: float = 15, flt: GlobalFilter = ALL
) -> DataFrame:
    """Revenue share of the top ``top`` of the stations, if above ``pct``."""
    return _revenue_concentration(_rollup(t, flt), top, pct)


def insight_failure(t: Tables, pct: float = 3, ratio: float = 2, flt: GlobalFilter = ALL) -> DataFrame:
    """The station failing most (more revenue first on a tie), if above ``pct`` and ``ratio`` times the mean."""
    return _failure(_rollup(t, flt), pct, ratio)


def insight_underutilized(
    t: Tables, util: float = 2, mean: float = 5, zero_active: str = "inf", flt: GlobalFilter = ALL
) -> DataFrame:
    """The least utilized station with active chargers, if below ``util`` while the mean is above ``mean``."""
    return _underutilized(_rollup(t, flt), util, mean, zero_active)


def insight_peak_hour(t: Tables, ratio: float = 1.3, flt: GlobalFilter = ALL) -> DataFrame:
    """The busiest hour, if above ``ratio`` times the mean of the observed hours."""
    return _peak_hour(_rollup(t, flt), ratio)


def insight_campers(
    t: Tables, minutes: int = CAMPER_MINUTES, kwh: float = CAMPER_KWH, min_count: int = 50, flt: GlobalFilter = ALL
) -> DataFrame:
    """Number of sessions above ``minutes`` and below ``kwh``, if more than ``min_count``."""
    return _campers(_rollup(t, flt, minutes, kwh), minutes, kwh, min_count)


def insights(t: Tables, zero_active: str = "inf", flt: GlobalFilter = ALL) -> DataFrame:
    """All findings that fire, in rule order, from one pass over the sessions."""
    r = _rollup(t, flt)
    return (
        _capacity_pressure(r, zero_active=zero_active)
        .unionByName(_revenue_concentration(r))
        .unionByName(_failure(r))
        .unionByName(_underutilized(r, zero_active=zero_active))
        .unionByName(_peak_hour(r))
        .unionByName(_campers(r))
        .orderBy("insight_id")
    )
