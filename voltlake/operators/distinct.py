"""Distinct counts over any run of months, from mergeable sketches; opt-in, beside the exact counts.

An exact distinct count of a period cannot be put together from those of its months, so every new period reads the
fact again and shuffles its ids. A HyperLogLog sketch can be merged: :func:`monthly_sketches` makes one row a month
in one pass (map-side, no id is shuffled), is meant to be stored and appended to month by month, and
:func:`distinct_in_months` and :func:`trailing_distinct` answer from it without the fact. The relative standard
error of an estimate is :func:`standard_error`, for any number of merged months.
"""

from __future__ import annotations

import datetime as dt
from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.sources.filters import ALL, GlobalFilter, filtered_sessions
from voltlake.sources.tables import Tables

#: Logarithm of the registers of a sketch: 16,384 registers, at most 8 kB a sketch.
LG_K = 14
#: What is counted, and the column whose values are.
COUNTED = {"customers": "customer_id", "stations": "station_id", "chargers": "charger_id"}


def standard_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a merged sketch: 1.04 over the root of its registers."""
    return 1.04 / sqrt(2 ** lg_k)


def monthly_sketches(t: Tables, flt: GlobalFilter = ALL, lg_k: int = LG_K) -> DataFrame:
    """Per month of start: the sessions and a sketch of each of ``COUNTED``, as a binary column.

    Sessions without a start belong to no month. NULL ids are not counted, as in an exact distinct count.
    """
    months = filtered_sessions(t, flt).filter(F.col("start_time").isNotNull())
    return months.groupBy(F.trunc(F.to_date("start_time"), "month").alias("month")).agg(
        F.count(F.lit(1)).alias("sessions"),
        *[F.hll_sketch_agg(column, lg_k).alias(f"{name}_sketch") for name, column in COUNTED.items()],
    )


def _merged() -> list:
    estimates = [
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"{name}_sketch")), F.lit(0).cast("long")).alias(name)
        for name in COUNTED
    ]
    return [F.coalesce(F.sum("sessions"), F.lit(0).cast("long")).alias("sessions"), *estimates]


def distinct_in_months(sketches: DataFrame, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """One row: sessions and the estimated distinct customers, stations and chargers from month ``first`` to ``last``.

    Both ends belong to the period; None leaves an end open. A period without sessions counts 0.
    """
    if first is not None:
        sketches = sketches.filter(F.col("month") >= F.lit(first.replace(day=1)))
    if last is not None:
        sketches = sketches.filter(F.col("month") <= F.lit(last.replace(day=1)))
    return sketches.agg(*_merged())


def trailing_distinct(sketches: DataFrame, months: int = 3) -> DataFrame:
    """Per month with sessions: sessions and estimated distinct counts of it and the ``months`` - 1 before it.

    Every sketch is sent to the months whose period it belongs to; what is shuffled is ``months`` rows a month.
    """
    if months < 1:
        raise ValueError("a period has at least one month")
    reach = F.sequence(F.lit(0), F.lit(months - 1))
    sent = sketches.withColumn("ahead", F.explode(reach)).withColumn("until", F.add_months("month", F.col("ahead")))
    return (
        sent.groupBy("until").agg(F.bool_or(F.col("ahead") == 0).alias("present"), *_merged())
        .filter("present").drop("present").withColumnRenamed("until", "month").orderBy("month")
    )


def trailing_distinct_check(t: Tables, months: int = 3, sigmas: float = 4, flt: GlobalFilter = ALL, lg_k: int = LG_K) -> DataFrame:
    """The estimates of :func:`trailing_distinct` against exact counts: per month the exact count of each, and
    whether the estimate lies within ``sigmas`` standard errors of it (and half a unit, for small counts).

    The exact side first reduces the sessions to distinct (month, id) pairs and shuffles those.
    """
    estimated = trailing_distinct(monthly_sketches(t, flt, lg_k), months)
    s = filtered_sessions(t, flt).filter(F.col("start_time").isNotNull())
    month = F.trunc(F.to_date("start_time"), "month").alias("month")
    reach = F.explode(F.sequence(F.lit(0), F.lit(months - 1))).alias("ahead")
    out = estimated
    for name, column in COUNTED.items():
        pairs = s.select(month, F.col(column).alias("id")).distinct().select("month", "id", reach)
        exact = pairs.groupBy(F.add_months("month", F.col("ahead")).alias("month")).agg(
            F.count_distinct("id").alias(f"exact_{name}"))
        out = out.join(exact, "month")
    bound = sigmas * standard_error(lg_k)
    return out.select(
        "month", "sessions", *[f"exact_{name}" for name in COUNTED],
        *[
            (F.abs(F.col(name) - F.col(f"exact_{name}")) <= F.col(f"exact_{name}") * bound + 0.5).alias(f"{name}_within")
            for name in COUNTED
        ],
    ).orderBy("month")
