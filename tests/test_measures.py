"""Exact sums with missing values, and z-scores that do not depend on partitions."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from voltlake.fixtures.mapping import network
from voltlake.functions import measures as m
from voltlake.operators import charger, network as net, noc, reports, revenue
from voltlake.sources.tables import Tables


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.25,), (float("nan"),), (None,), (2.5,)], "x double")
    by_name, by_column = df.agg(m.exact_sum("x").alias("a"), m.exact_sum(df.x).alias("b")).first()
    assert by_name == 3.75 and by_column == 3.75
    assert spark.createDataFrame([(float("nan"),)], "x double").agg(m.exact_sum("x").alias("a")).first().a == 0.0


def test_zscores_do_not_depend_on_partitions(spark):
    t = network(spark, f"{TESTDATA}/sf0.001")
    got = [
        sorted(map(tuple, noc.noc_zscore_behavior(Tables(t.stations, t.chargers, t.sessions.repartition(n))).collect()))
        for n in (1, 7, 23)
    ]
    assert got[0] == got[1] == got[2] and len(got[0]) > 1000


def test_zscores_equal_pandas(spark):
    t = network(spark, f"{TESTDATA}/sf0.001")
    pdf = noc.noc_zscore_behavior(t).toPandas()
    for value, z in (("duration_hrs", "duration_z"), ("energy_kwh", "energy_z")):
        want = (pdf[value] - pdf[value].mean()) / pdf[value].std()
        assert pdf[z].to_numpy() == pytest.approx(want.to_numpy(), abs=2e-6)


def test_sums_keep_eight_decimals(spark):
    """Digits beyond the fourth decimal are summed, not rounded away before."""
    df = spark.createDataFrame([(0.00004,)] * 3 + [(1.23456,)], "x double")
    by_name, by_column = df.agg(m.exact_sum("x").alias("a"), m.exact_sum(df.x).alias("b")).first()
    assert by_name == by_column == 1.23468
    rng = random.Random(5)
    texts = [f"{rng.choice('- ').strip()}{rng.randrange(10**6)}.{rng.randrange(10**8):08d}"[:-rng.randrange(1, 5)] for _ in range(3000)]
    values = spark.createDataFrame([(i % 3, float(t)) for i, t in enumerate(texts)], "k int, x double")
    for parts in (1, 13):
        rollup = values.repartition(parts).groupBy("k").agg(m.sum_units("x").alias("u"))
        want = [sum(Decimal(t) for t in texts[k::3]) for k in range(3)]
        assert [r.u for r in rollup.orderBy("k").collect()] == want
        assert rollup.agg(m.from_units(F.sum("u")).alias("u")).first().u == float(sum(want))


def test_sums_of_tiny_values_and_of_conditions(spark):
    df = spark.range(1_000_000).select(F.lit(0.00000001).alias("x"), (F.col("id") % 2 == 0).alias("even"))
    every, even = df.agg(m.exact_sum("x").alias("a"), m.exact_sum("x", F.col("even")).alias("b")).first()
    assert (every, even) == (0.01, 0.005)
    assert df.filter("x > 1").agg(m.total_units("x").alias("u")).first().u is None
    assert df.filter("x > 1").agg(m.sum_units("x").alias("u")).first().u == 0


def test_sums_beyond_a_double(spark):
    """9 * 10^12 units and a hundred-millionth: the sum has 21 digits, and all are there."""
    df = spark.createDataFrame([(9e12,), (1e-8,), (9e12,), (-9e12,)], "x double")
    assert df.agg(m.sum_units("x").alias("u")).first().u == Decimal("9000000000000.00000001")


def test_operators_keep_eight_decimals(spark):
    """A network whose revenue has six decimals: totals, rollups, reports and findings agree with the exact sum."""
    t = network(spark, f"{TESTDATA}/sf0.001")
    six = F.col("revenue") + F.col("session_id").cast("string").cast("long") % 100 / F.lit(1e6)
    t = Tables(t.stations, t.chargers, t.sessions.withColumn("revenue", F.round(six, 6)))
    want = float(sum(Decimal(repr(r.revenue)) for r in t.sessions.select("revenue").collect() if r.revenue is not None))
    assert net.landing_kpis(t).first()["total_revenue"] == want
    assert reports.sql01_network_kpis(t).first()["total_revenue_usd"] == want
    assert revenue.revenue_kpis(t).first()["total_revenue"] == want
    by_charger = charger.charger_stats(t).select("charger_id", "avg_revenue")
    sums = {}
    for r in t.sessions.filter("revenue IS NOT NULL").select("charger_id", "revenue").collect():
        sums.setdefault(r.charger_id, []).append(Decimal(repr(r.revenue)))
    got = {r.charger_id: r.avg_revenue for r in by_charger.collect() if r.charger_id in sums}
    assert got == {k: float(sum(v)) / len(v) for k, v in sums.items() if k in got} and len(got) > 50
