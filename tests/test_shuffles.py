"""What the shuffles of a query carry, from its plan without broadcasts."""

from __future__ import annotations

import re

import pytest

from conftest import TESTDATA
from tiny import charger, rows, session, station, tables
from voltlake.fixtures.mapping import faulty_network, network
from voltlake.operators import charger as chargers, model, quality

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.enabled": "false",
}


@pytest.fixture
def plan(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("operator", [chargers.anomaly_log, chargers.anomaly_log_by_severity])
def test_passes_of_the_log_share_a_shuffle(spark, plan, operator):
    text = plan(operator(network(spark, f"{TESTDATA}/sf0.001")))
    scans = re.findall(r"FileScan parquet \[l_.*?PushedFilters: (\[.*?\])", text)
    assert scans and len(set(scans)) == 1


def test_sessions_without_a_start_are_in_no_window(spark):
    none = dict(start_time=None)
    s = [session(k, day=k % 40, revenue=50.0 if k % 40 < 20 else 1.0) for k in range(80)] + [session(90, **none), session(91, charger_id=None)]
    t = tables(spark, [station(1)], [charger(1, "S1")], s)
    wanted = [chargers.REVENUE_DROP, chargers.UTILIZATION_DROP]
    alone = rows(chargers.anomaly_revenue_drop(t)) + rows(chargers.anomaly_util_drop(t))
    assert [r for r in rows(chargers.anomaly_log(t)) if r["anomaly_type"] in wanted] == alone and len(alone) == 1


def test_summary_keeps_little_per_session(spark, plan):
    """Rows stream past the hashed pairs unsorted, and an id takes three numbers."""
    text = plan(quality.dq_summary(faulty_network(spark, f"{TESTDATA}/sf0.001")))
    joins = [line for line in text.splitlines() if "bad_station" in line and "Join" in line]
    assert joins and all("ShuffledHashJoin" in line for line in joins)
    per_id = re.findall(r"HashAggregate\(keys=\[session_id#\d+L?\], functions=\[(.*?)\], output", text) or \
        re.findall(r"HashAggregate\(keys=\[session_id#\d+L?\], functions=\[(.*)\]", text)
    assert per_id and all(len(re.findall(r"(?:count|bit_or)\(", f)) <= 3 for f in per_id)


def test_summary_by_hand(spark):
    good = [session(k) for k in range(4)]
    bad = [
        session(10, vehicle_type=None), session(11, minutes=0), session(12, energy=-1.0), session(13, revenue=-1.0),
        session(14, station_id="S9"), session(15, charger_id="C9"), session(16, station_id="S2"),
        session(17, charger_id=None), session(18), session(18), session(19, station_id=None),
    ]
    t = tables(spark, [station(1), station(2)], [charger(1, "S1"), charger(2, "S9")], good + bad)
    got = quality.dq_summary(t).first().asDict()
    # all ten rules: zero minutes end when they start
    assert (got["total_records"], got["invalid_records"], got["warnings"]) == (15, 11, 10)
    flags = quality.dq_flags(t).filter("is_invalid").count()
    assert flags == 11
    empty = quality.dq_summary(tables(spark, [station(1)], [charger(1, "S1")], [])).first().asDict()
    assert (empty["total_records"], empty["invalid_records"], empty["warnings"]) == (0, 0, 0)


def test_looked_up_names_do_not_travel(spark, plan):
    """A side that is broadcast joins after the one that shuffles; hot keys are counted on the sessions alone."""
    t = network(spark, f"{TESTDATA}/sf0.001")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
    names = network(spark, f"{TESTDATA}/sf0.001").stations
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    lines = plan(model.enrich_sessions(type(t)(names, t.chargers, t.sessions))).splitlines()
    salted = next(k for k, line in enumerate(lines) if "Exchange hashpartitioning(charger_id" in line and "_salt" in line)
    assert "station_name" not in lines[salted + 1] and any("station_name" in line for line in lines[:salted])
    text = plan(model.enrich_sessions(t))  # both sides shuffle
    lines = text.splitlines()
    deep = [re.search(r"\w", line).start() if re.search(r"\w", line) else 0 for line in lines]
    counts = [k for k, line in enumerate(lines) if "partial_approx_top_k" in line]
    assert len(counts) >= 2
    for k in counts:
        end = next((j for j in range(k + 1, len(lines)) if deep[j] <= deep[k]), len(lines))
        assert not any("_salt" in line for line in lines[k:end])
