"""Exact sums and guarded rates.

Money and energy are summed in two BIGINT parts: whole ten-thousandths, and what a value has beyond
them in hundred-millionths (-5,000 to 5,000, so that 10^15 rows fit). Nothing is rounded before it is
summed, down to the eighth decimal; the result does not depend on the order in which partitions are
merged, and the partial aggregate stays in generated code (a DECIMAL buffer would not). The two sums
meet in one DECIMAL of eight decimals, one per group, which further sums keep exact. The first part
holds 9.2e14 currency units or kWh; beyond that ANSI mode raises, it never wraps.

Plain column names take the short way over a SQL expression: every Column call
is a round trip to the JVM, and plans here have hundreds of measures.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 10_000
FINE = SCALE * SCALE
#: Type of an exact sum; sums of such sums widen it.
EXACT = "decimal(24,8)"
MINUTES_PER_DAY = 24 * 60
INF = float("inf")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _units_sql(c: str) -> tuple[str, str]:
    """A value in ten-thousandths, and the rest in hundred-millionths; NaN is missing, as NULL is."""
    value = f"nullif(CAST({c} AS DOUBLE), double('NaN'))"
    near = f"rint({value} * {SCALE})"
    return f"CAST({near} AS BIGINT)", f"CAST(rint(({value} - {near} / {float(SCALE)}D) * {FINE}) AS BIGINT)"


def _units(c: Column | str) -> tuple[Column, Column]:
    if isinstance(c, str):
        first, rest = _units_sql(c)
        return F.expr(first), F.expr(rest)
    value = F.when(~F.isnan(_col(c).cast("double")), _col(c).cast("double"))
    near = F.rint(value * SCALE)
    return near.cast("long"), F.rint((value - near / F.lit(float(SCALE))) * FINE).cast("long")


def fine_units(c: Column | str) -> Column:
    """A money or energy value in whole hundred-millionths; NaN is missing, as NULL is."""
    first, rest = _units(c)
    return first * SCALE + rest


def parts(name: str, c: str) -> dict[str, Column]:
    """The two sums of a column as BIGINT measures ``name`` and ``name``_rest, for :func:`joined`."""
    first, rest = _units_sql(c)
    return {name: F.expr(f"coalesce(sum({first}), 0)"), f"{name}_rest": F.expr(f"coalesce(sum({rest}), 0)")}


def joined(first: Column, rest: Column) -> Column:
    """Both parts of a sum as one DECIMAL."""
    tenthousandths = first.cast("decimal(19,0)") * F.expr("0.0001BD")
    return (tenthousandths + rest.cast("decimal(19,0)") * F.expr("0.00000001BD")).cast(EXACT)


def total_units(c: Column | str, when: Column | None = None) -> Column:
    """Exact sum as DECIMAL; NULL for no values."""
    if isinstance(c, str) and when is None:
        first, rest = (f"CAST(sum({part}) AS DECIMAL(19,0))" for part in _units_sql(c))
        return F.expr(f"CAST({first} * 0.0001BD + {rest} * 0.00000001BD AS {EXACT})")
    first, rest = (F.sum(part if when is None else F.when(when, part)) for part in _units(c))
    return joined(first, rest)


def sum_units(c: Column | str, when: Column | None = None) -> Column:
    """Exact sum as DECIMAL; 0 for no values."""
    return F.coalesce(total_units(c, when), F.lit(0).cast(EXACT))


def sum_long(c: Column | str, when: Column | None = None) -> Column:
    """Sum of an integer column as BIGINT; 0 for no rows."""
    if isinstance(c, str) and when is None:
        return F.expr(f"coalesce(sum(CAST({c} AS BIGINT)), 0)")
    value = _col(c).cast("long")
    return F.coalesce(F.sum(value if when is None else F.when(when, value)), F.lit(0))


def from_units(c: Column | str) -> Column:
    """An exact sum as the nearest DOUBLE."""
    return _col(c).cast("double")


def exact_sum(c: Column | str, when: Column | None = None) -> Column:
    """Order-independent sum of a money or energy column, as DOUBLE."""
    return from_units(sum_units(c, when))


def as_long(c: Column | str) -> Column:
    return _col(c).cast("long")


def rate(n: Column | str, d: Column | str) -> Column:
    """n / d, and 0 where the quotient does not exist."""
    if isinstance(n, str) and isinstance(d, str):
        return F.expr(f"coalesce(try_divide(CAST({n} AS DOUBLE), CAST({d} AS DOUBLE)), 0.0D)")
    return F.coalesce(F.try_divide(_col(n).cast("double"), _col(d).cast("double")), F.lit(0.0))


def open_rate(n: Column | str, d: Column | str, zero_by_zero: float | None = None) -> Column:
    """n / d with the floating-point reading of a zero divisor.

    A positive n over 0 is infinite; 0 over 0 is ``zero_by_zero`` (NULL when not given).
    """
    n, d = _col(n).cast("double"), _col(d).cast("double")
    return (
        F.when((d == 0) & (n > 0), F.lit(INF))
        .when((d == 0) & (n < 0), F.lit(-INF))
        .when((d == 0) & (n == 0), F.lit(zero_by_zero).cast("double"))
        .otherwise(F.try_divide(n, d))
    )


def sql_rate(n: Column | str, d: Column | str) -> Column:
    """n / NULLIF(d, 0): NULL where the divisor is 0."""
    if isinstance(n, str) and isinstance(d, str):
        return F.expr(f"try_divide(CAST({n} AS DOUBLE), CAST({d} AS DOUBLE))")
    return F.try_divide(_col(n).cast("double"), _col(d).cast("double"))


def is_status(value: str) -> Column:
    return F.col("session_status") == value


def count_status(value: str) -> Column:
    return F.expr(f"count_if(session_status = '{value}')")


# --- the four utilization denominators; they look alike and are not the same ---


def station_utilization(minutes: Column | str, active: Column | str, days: Column) -> Column:
    """Percent of the minutes of a station's active chargers; 0 without any."""
    return rate(minutes, as_long(active) * days * MINUTES_PER_DAY) * 100.0


def open_station_utilization(
    minutes: Column | str, active: Column | str, days: Column, zero_active: str = "inf"
) -> Column:
    """Like :func:`station_utilization`, but infinite where no charger is active.

    ``zero_active='exclude'`` gives NULL there instead.
    """
    capacity = as_long(active) * days * MINUTES_PER_DAY
    if zero_active == "exclude":
        return sql_rate(minutes, capacity) * 100.0
    if zero_active != "inf":
        raise ValueError("zero_active must be 'inf' or 'exclude'")
    return open_rate(minutes, capacity) * 100.0


def seen_charger_utilization(minutes: Column | str, seen: Column | str, days: Column) -> Column:
    """Percent of the minutes of the distinct chargers that had a session."""
    return open_rate(minutes, as_long(seen) * days * MINUTES_PER_DAY) * 100.0


def charger_utilization(minutes: Column | str, days: Column) -> Column:
    """Percent of one charger's minutes."""
    return rate(minutes, as_long(days) * MINUTES_PER_DAY) * 100.0


def slot_utilization(sessions: Column | str, chargers: Column | str, days: int) -> Column:
    """Sessions over one-hour slots of all chargers, in percent."""
    return rate(sessions, as_long(chargers) * (24 * days)) * 100.0


def pressure(value: Column, full: float) -> Column:
    """Scale to 0..100, where ``full`` and above is 100."""
    return F.least(F.lit(100.0), value / F.lit(float(full)) * 100.0)
