"""What grows with the input: queries and garbage of the driver, sides that are broadcast."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltlake.llm import common


def test_a_round_of_components_is_one_query(spark, monkeypatch):
    """The mark of the edges is taken while they are written; the plans of the rounds are collected once, at the end."""
    written, collected, real = [], [], common.stored
    monkeypatch.setattr(common, "stored", lambda frame, name: written.append(name) or real(frame, name))
    monkeypatch.setattr(common, "collect_garbage", lambda session: collected.append(session))
    bus, store = spark._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    last = max((e.executionId() for e in [store.executionsList().apply(k) for k in range(store.executionsList().size())]), default=-1)
    found = common.components(spark.range(40).selectExpr("id AS u", "id + 1 AS v"))
    bus.waitUntilEmpty()
    executions = store.executionsList()
    new = sum(executions.apply(k).executionId() > last for k in range(executions.size()))
    assert new == len(written) > 2 and len(collected) == 1
    assert {r["component"] for r in found.collect()} == {0}


def test_components_of_no_edges(spark):
    for edges in ([], [(1, 1), (2, None)]):
        assert common.components(spark.createDataFrame(edges, "u long, v long")).collect() == []


def test_many_shared_members_are_not_broadcast(spark, monkeypatch):
    """Above some tens of thousands of shared members, their counts take the same way at every size."""
    plans, real = {}, common.stored

    def stored(frame, name):
        plans[name] = frame._jdf.queryExecution().analyzed().toString()
        return real(frame, name)

    monkeypatch.setattr(common, "stored", stored)
    sets = spark.range(120).select("id", F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda k: (F.col("id") % 60) * 2000 + k).alias("members"))
    buckets = common.rarest_buckets(sets, 0.8)
    assert buckets.count() == 120 * 401 and buckets.select("key").distinct().count() == 60 * 401
    assert "broadcast" not in plans["set-buckets"]
    common.rarest_buckets(sets.where("id % 60 < 5"), 0.8)
    assert "broadcast" in plans["set-buckets"]
