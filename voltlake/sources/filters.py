"""The session filter every operator accepts.

It restricts sessions only. Stations and chargers stay whole, so with a city
filter the network's active chargers still count in network utilization.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions import calendar as cal
from voltlake.sources.tables import MONTH_PARTITION, Tables


@dataclass(frozen=True)
class GlobalFilter:
    """Six optional restrictions; None means all. Dates are inclusive on both ends."""

    date_from: dt.date | None = None
    date_to: dt.date | None = None
    city: str | None = None
    station_id: Any = None
    charger_type: str | None = None
    vehicle_type: str | None = None
    session_status: str | None = None


ALL = GlobalFilter()
#: Later than any month directory.
NEVER = dt.date(9999, 12, 31)


def _midnight(d: dt.date):
    return F.lit(d.isoformat()).cast("timestamp_ntz")


def since(sessions: DataFrame, moment: Column, inclusive: bool = False, shared: bool = False) -> DataFrame:
    """Sessions that start after ``moment`` (or at it, if ``inclusive``).

    Where the table has month directories, the month of the moment is a bound on them as well: a scalar
    subquery as moment then prunes directories at run time. The bound on start_time alone skips nothing.
    ``shared`` is for a query that reads ``sessions`` elsewhere, too: of a comparison Spark infers that its columns
    are not NULL and asks for that below the joins that made the sessions, so that this reader would have
    shuffles of its own. Nothing is inferred where a NULL comparison is false.
    """
    start = F.col("start_time")
    bound = start >= moment if inclusive else start > moment
    late = sessions.filter(F.coalesce(bound, F.lit(False)) if shared else bound)
    if MONTH_PARTITION in sessions.columns:
        late = late.filter(F.col(MONTH_PARTITION) >= F.trunc(F.to_date(moment), "month"))
    return late


#: Months of each step of the search for the last start; the step after them reads the rest.
STEPS = (1, 12)


def last_start(t: Tables, sessions: DataFrame, flt: GlobalFilter = ALL) -> Column:
    """The greatest start of ``sessions``, the sessions of ``t`` that pass ``flt``, as a scalar subquery.

    With month directories the newest month is searched first, then the twelve before it, then the rest; a step
    after the one that found a session prunes every directory at run time and reads nothing. Else one scan of
    the start times.
    """
    months = [month for month in t.months if flt.date_to is None or month <= flt.date_to]
    found = None
    for at, end in ((0, STEPS[0]), (STEPS[0], sum(STEPS)), (sum(STEPS), len(months))):
        part = months[at:end]
        if len(months) < 2 or not part:
            break
        lowest = F.lit(part[-1])
        if found is not None:
            lowest = F.when(found.isNull(), lowest).otherwise(F.lit(NEVER))
        step = sessions.filter((F.col(MONTH_PARTITION) >= lowest) & (F.col(MONTH_PARTITION) <= F.lit(part[0])))
        last = cal.last_start(step)
        found = last if found is None else F.coalesce(found, last)
    return cal.last_start(sessions) if found is None else found


def filtered_sessions(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """The sessions that pass ``flt``, without added columns.

    Dates become bounds on start_time, and on the month directories where the
    table has them, which are then not read. City and charger type are
    semi joins: no dimension column is carried along.
    """
    s = t.sessions
    by_month = MONTH_PARTITION in s.columns
    if flt.date_from is not None:
        s = s.filter(F.col("start_time") >= _midnight(flt.date_from))
        if by_month:
            s = s.filter(F.col(MONTH_PARTITION) >= F.lit(flt.date_from.replace(day=1)))
    if flt.date_to is not None:
        s = s.filter(F.col("start_time") < _midnight(flt.date_to + dt.timedelta(days=1)))
        if by_month:
            s = s.filter(F.col(MONTH_PARTITION) <= F.lit(flt.date_to.replace(day=1)))
    for column in ("station_id", "vehicle_type", "session_status"):
        wanted = getattr(flt, column)
        if wanted is not None:
            s = s.filter(F.col(column) == F.lit(wanted))
    if flt.city is not None:
        in_city = t.stations.filter(F.col("city") == F.lit(flt.city)).select("station_id")
        s = s.join(in_city, "station_id", "left_semi").select(*s.columns)
    if flt.charger_type is not None:
        of_type = t.chargers.filter(F.col("charger_type") == F.lit(flt.charger_type)).select("charger_id")
        s = s.join(of_type, "charger_id", "left_semi").select(*s.columns)
    return s
