"""What every plan must and must not contain."""

from __future__ import annotations

import re

import pytest

from conftest import TESTDATA
from voltlake.fixtures import queries as named_queries

SF = f"{TESTDATA}/sf0.001"
QUERIES = {k: v for k, v in named_queries.queries().items() if k not in ("write_tables", "raw_scan", "unreadable_records") and not k.startswith(("csv_", "parquet_"))}

# Queries with an unpartitioned window, and what bounds the rows that reach it.
MINUTES = "at most 65,536 ranges of minutes"
BOUNDED = {
    "peak_hours": "24 hours",
    "peak_windows": "24 hours",
    "peak_vs_offpeak": "24 hours",
    "sql06_monthly_revenue": "months",
    "sql07_top_stations": "the first n rows",
    "segment_summary": "four segments",
    "anomaly_long_session": MINUTES,
    "anomaly_camper": MINUTES,
    "anomaly_log": MINUTES,
    "anomaly_log_by_severity": MINUTES,
}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _nodes(plan):
    """All nodes of an optimized plan, subqueries included."""
    yield plan
    for children in (plan.children(), plan.subqueries()):
        for i in range(children.size()):
            yield from _nodes(children.apply(i))


def _has_unpartitioned_window(df) -> bool:
    return any(
        n.nodeName() == "Window" and n.partitionSpec().isEmpty()
        for n in _nodes(df._jdf.queryExecution().optimizedPlan())
    )


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(name, spark):
    df = QUERIES[name](spark, SF)
    plan = _plan(df)
    for unwanted in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct",
                     "BroadcastNestedLoopJoin", "SerializeFromObject"):
        assert unwanted not in plan
    assert not _has_unpartitioned_window(df) or name.split("_of_")[0] in BOUNDED


def test_scans_read_few_columns(spark):
    plan = _plan(QUERIES["sessions_by_hour"](spark, SF))
    scan = re.search(r"FileScan parquet \[([^\]]*l_orderkey[^\]]*)\]", plan).group(1)
    assert "l_extendedprice" not in scan and "l_quantity" not in scan


def test_quantile_inputs_are_shuffled_once(spark):
    """All counts and the result read one shuffle of the customer totals."""
    df = QUERIES["customer_segments"](spark, SF)
    df.collect()
    assert "ReusedExchange" in _plan(df)
