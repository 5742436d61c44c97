"""How often a query reads the fact, by the rows its scans have read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from voltlake.fixtures.mapping import network
from voltlake.operators import charger, insights, quality
from voltlake.sources.tables import CHARGERS, SESSION_COLUMNS, STATIONS, Tables, load_tables, write_tables


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Tables in files; sessions by month."""
    t = network(spark, f"{TESTDATA}/sf0.01")
    undated = t.chargers.withColumn("installation_date", F.lit(None).cast("date"))
    path = str(tmp_path_factory.mktemp("network"))
    write_tables(Tables(t.stations.select(*STATIONS.names), undated.select(*CHARGERS.names), t.sessions.select(*SESSION_COLUMNS)), path)
    return load_tables(spark, path, "parquet")


def rows_read(df) -> int:
    """Rows that the scans of a run of ``df`` have read."""
    return counted(df, "inputRecords")


def counted(df, what: str) -> int:
    """A metric of a run of ``df``, over all its stages."""
    store = df.sparkSession.sparkContext._jsc.sc().statusStore()

    def total():
        jobs = store.jobsList(None)
        stages = {jobs.apply(i).stageIds().apply(k) for i in range(jobs.size()) for k in range(jobs.apply(i).stageIds().size())}
        return sum(getattr(store.lastStageAttempt(k), what)() for k in stages)

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


@pytest.mark.parametrize("query, passes", [
    (insights.insights, 1), (insights.insight_revenue_concentration, 1), (insights.insight_capacity_pressure, 1),
    (charger.charger_stats, 1), (charger.anomaly_high_failure, 1), (charger.anomaly_long_session, 2), (charger.anomaly_log, 3),
])
def test_passes_over_the_sessions(spark, stored, query, passes):
    fact = stored.sessions.count()
    small = stored.stations.count() + stored.chargers.count()
    # one finding reads the small tables more than once
    assert rows_read(query(stored)) <= passes * fact + 12 * small


@pytest.mark.parametrize("query, shuffles", [(quality.dq_summary, 2), (quality.dq_flags, 3)])
def test_quality_joins_the_sessions_once(spark, stored, query, shuffles):
    """Without broadcasts: one shuffle by (station, charger), and by session_id one for the counts and one for the rows that come back."""
    fact = stored.sessions.count()
    small = stored.stations.count() + stored.chargers.count()
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in before:
            spark.conf.set(k, "-1")
        assert counted(query(stored), "shuffleWriteRecords") <= shuffles * fact + 40 * small
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
