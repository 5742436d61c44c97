"""Sketches of distinct counts: merged months against exact counts."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from test_passes import counted
from tiny import charger, session, station, tables
from voltlake.fixtures.mapping import network
from voltlake.operators import distinct as d


def test_merged_months_equal_the_sketch_of_the_period(spark):
    """The error does not grow with the months merged: the union is the sketch of all their values."""
    t = network(spark, f"{TESTDATA}/sf0.01")
    first, last = dt.date(2024, 11, 1), dt.date(2025, 6, 1)
    sketches = d.monthly_sketches(t)
    got = d.distinct_in_months(sketches, first, last).first()
    period = t.sessions.filter((F.col("start_time") >= "2024-11-01") & (F.col("start_time") < "2025-07-01"))
    want = period.agg(
        F.count(F.lit(1)).alias("sessions"),
        *[F.count_distinct(c).alias(name) for name, c in d.COUNTED.items()],
    ).first()
    assert got["sessions"] == want["sessions"]
    for name in d.COUNTED:
        assert want[name] > 0 and abs(got[name] - want[name]) <= 4 * d.standard_error() * want[name] + 0.5
    whole = d.distinct_in_months(sketches).first()
    assert whole["sessions"] == t.sessions.count()


def test_coarse_sketches_keep_their_error(spark):
    ids = spark.range(200_000).select((F.col("id") % 50_000).alias("customer_id"), (F.col("id") % 12).alias("m"))
    months = ids.groupBy("m").agg(F.hll_sketch_agg("customer_id", 10).alias("s"))
    estimate = months.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("n")).first()["n"]
    assert 0 < abs(estimate - 50_000) <= 4 * d.standard_error(10) * 50_000


def test_periods_are_answered_without_the_fact(spark, tmp_path):
    t = network(spark, f"{TESTDATA}/sf0.001")
    d.monthly_sketches(t).write.parquet(str(tmp_path / "sketches"))
    kept = spark.read.parquet(str(tmp_path / "sketches"))
    months = kept.count()
    assert counted(d.distinct_in_months(kept), "inputRecords") <= months
    assert counted(d.trailing_distinct(kept, 3), "shuffleWriteRecords") <= 3 * months + 2 * (months + 3)


def test_trailing_months_edges(spark):
    day = lambda k, **kw: session(k, day=k, **kw)
    sessions = [
        day(0, customer_id="a"), day(1, customer_id="b"), day(2, customer_id=None),  # March
        day(31, customer_id="a"), day(32, customer_id="a"),  # April
        day(100, customer_id="c"),  # June, May has none
        session(7, start_time=None, customer_id="z"),
    ]
    t = tables(spark, [station(1)], [charger(1, "S1")], sessions)
    sketches = d.monthly_sketches(t)
    got = {(r["month"].month): (r["sessions"], r["customers"], r["stations"]) for r in d.trailing_distinct(sketches, 2).collect()}
    assert got == {3: (3, 2, 1), 4: (5, 2, 1), 6: (1, 1, 1)}
    one = {r["month"].month: r["customers"] for r in d.trailing_distinct(sketches, 1).collect()}
    assert one == {3: 2, 4: 1, 6: 1}
    empty = d.distinct_in_months(sketches, first=dt.date(2030, 1, 1)).first()
    assert tuple(empty) == (0, 0, 0, 0)
    check = d.trailing_distinct_check(t, 2).collect()
    assert [(r["exact_customers"], r["customers_within"]) for r in check] == [(2, True), (2, True), (1, True)]
    assert d.trailing_distinct(d.monthly_sketches(tables(spark, [], [], [])), 3).count() == 0
    with pytest.raises(ValueError):
        d.trailing_distinct(sketches, 0)
