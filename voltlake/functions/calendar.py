"""Calendar parts of a session start, and the two meanings of "days"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English names in calendar order.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)


def day(start: Column | str = "start_time") -> Column:
    return F.to_date(start)


def hour(start: Column | str = "start_time") -> Column:
    return F.hour(start).cast("long")


def weekday_number(d: Column | str) -> Column:
    """0 = Monday .. 6 = Sunday."""
    return F.weekday(d)


def weekday_name_of(number: Column) -> Column:
    names = ", ".join(f"'{n}'" for n in WEEKDAYS)
    return F.element_at(F.expr(f"array({names})"), number.cast("int") + 1)


def weekday_name(d: Column | str) -> Column:
    return weekday_name_of(weekday_number(d))


def month_name(d: Column | str) -> Column:
    names = ", ".join(f"'{n}'" for n in MONTHS)
    return F.element_at(F.expr(f"array({names})"), F.month(d))


def is_weekend(d: Column | str) -> Column:
    return weekday_number(d) >= 5


def _seconds_between(lo: Column, hi: Column) -> Column:
    return F.timestamp_diff("SECOND", lo, hi)


def date_span(sessions: DataFrame) -> Column:
    """Days between the first and the last calendar date, at least 1.

    A scalar subquery that reads the start time only; every reference to it in
    one query is computed once.
    """
    bounds = sessions.agg(F.min("start_time").alias("lo"), F.max("start_time").alias("hi"))
    days = F.greatest(F.datediff(F.to_date("hi"), F.to_date("lo")), F.lit(1))
    return bounds.select(F.coalesce(days, F.lit(1)).cast("long").alias("days")).scalar()


def elapsed_days(sessions: DataFrame) -> Column:
    """Whole 24-hour periods between the first and the last start, at least 1."""
    bounds = sessions.agg(F.min("start_time").alias("lo"), F.max("start_time").alias("hi"))
    return bounds.select(whole_days("lo", "hi").alias("days")).scalar()


def whole_days(lo: str, hi: str, empty: int = 1) -> Column:
    days = F.floor(_seconds_between(F.col(lo), F.col(hi)) / F.lit(86400))
    return F.coalesce(F.greatest(days, F.lit(1)), F.lit(empty)).cast("long")


def elapsed_hours(sessions: DataFrame) -> Column:
    """Hours between the first and the last start; 1 where that is 0."""
    bounds = sessions.agg(F.min("start_time").alias("lo"), F.max("start_time").alias("hi"))
    hours = _seconds_between(F.col("lo"), F.col("hi")) / F.lit(3600.0)
    return bounds.select(F.when(hours > 0, hours).otherwise(F.lit(1.0)).alias("hours")).scalar()


def last_start(sessions: DataFrame) -> Column:
    return sessions.agg(F.max("start_time").alias("last_start")).scalar()


def days_before(moment: Column, days: int) -> Column:
    return moment - F.expr(f"INTERVAL {int(days)} DAYS")


def micros(column: str) -> Column:
    """A timestamp as whole microseconds since 1970, for rollups of BIGINT measures."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def from_micros(value: Column) -> Column:
    return F.timestamp_add("MICROSECOND", value, F.lit("1970-01-01").cast("timestamp_ntz"))
