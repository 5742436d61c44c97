"""Lookup joins with hot and NULL keys, without broadcasts of the looked-up side."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from voltlake.fixtures.mapping import network
from voltlake.operators.model import enrich_sessions, global_filter
from voltlake.plans.skew import hot_keys, salted_lookup
from voltlake.sources.filters import GlobalFilter
from voltlake.sources.tables import Tables, fits_broadcast

UNSET = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
ROWS = 60_000


@pytest.fixture
def no_broadcast(spark):
    settings = {**dict.fromkeys(UNSET, "-1"), "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def skewed(spark):
    """A third of the rows with key 7, a sixth without a key, the rest over 2,000 keys (some unknown to the side)."""
    key = F.expr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 AND id % 2 = 0 THEN NULL ELSE 100 + id * 7919 % 2000 END")
    fact = spark.range(ROWS).select(F.col("id").alias("row"), key.alias("k"))
    side = spark.range(1900).select(F.expr("IF(id = 0, 7, 100 + id)").alias("k"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    return fact, side


def test_hot_keys_are_found(spark):
    fact, _ = skewed(spark)
    found = {r["hot_key"]: r["salts"] for r in hot_keys(fact, "k", 8).collect()}
    assert found == {7: 22, None: 11}  # ceil(64 / 3) and ceil(64 / 6)
    assert hot_keys(fact.limit(0), "k", 8).count() == 0


def test_join_tasks_are_even(spark, no_broadcast):
    fact, side = skewed(spark)

    def sizes(df):
        return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())

    plain, salted = sizes(fact.join(side, "k", "left").select("row", "name")), sizes(salted_lookup(fact, side, "k", "row"))
    assert sum(salted) == ROWS == sum(plain)
    assert plain[-1] > 3 * plain[len(plain) // 2]
    assert salted[-1] <= 2 * salted[len(salted) // 2]


def test_salted_lookup_equals_the_join(spark, no_broadcast):
    fact, side = skewed(spark)
    twice = side.unionByName(side.filter("k = 7"))  # a repeated key on the side repeats rows, as in any join
    for right in (side, twice, side.limit(0)):
        want = fact.join(right, "k", "left")
        got = salted_lookup(fact, right, "k", "row")
        assert got.columns == want.columns
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert salted_lookup(fact.limit(0), side, "k", "row").count() == 0


def test_enriched_sessions_without_broadcast(spark):
    """One station at a third of the sessions; the same rows with and without broadcasts."""
    t = network(spark, f"{TESTDATA}/sf0.001")
    hot = F.expr("CASE WHEN session_id % 3 = 0 THEN 7 WHEN session_id % 50 = 1 THEN NULL ELSE station_id END")
    t = Tables(t.stations, t.chargers, t.sessions.withColumn("station_id", hot))
    flt = GlobalFilter(vehicle_type="Brand#4")
    want = enrich_sessions(t).collect(), global_filter(t, flt).collect()
    before = {k: spark.conf.get(k, None) for k in UNSET}
    try:
        for k in UNSET:
            spark.conf.set(k, "-1")
        s = network(spark, f"{TESTDATA}/sf0.001")  # without hints
        t = Tables(s.stations, s.chargers, t.sessions)
        assert not fits_broadcast(t.stations) and not fits_broadcast(t.chargers)
        for df, rows in zip((enrich_sessions(t), global_filter(t, flt)), want):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "_salt" in plan and "approx_top_k" in plan
            assert sorted(map(str, df.collect())) == sorted(map(str, rows))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
