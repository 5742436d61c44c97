"""Relations between operators that hold on any data."""

from __future__ import annotations

import pytest

from conftest import TESTDATA
from tiny import rows
from voltlake.fixtures.mapping import faulty_network, network
from voltlake.operators import capacity, customer, demand, network as net, noc, quality, reports, revenue

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return network(spark, SF)


def test_segments_partition_customers(t):
    summary = rows(customer.segment_summary(t))
    assert sum(r["customers"] for r in summary) == rows(customer.customer_kpis(t))[0]["customers"]
    assert sum(r["pct_of_revenue"] for r in summary) == pytest.approx(100)


def test_quadrants_partition_stations_with_sessions(t):
    got = rows(revenue.revenue_quadrants(t))
    assert len(got) == t.sessions.select("station_id").distinct().count()
    assert sum(r["quadrant"].startswith("High Util") for r in got) >= len(got) / 2


def test_valid_and_invalid_make_the_total(spark):
    raw = faulty_network(spark, SF)
    s = rows(quality.dq_summary(raw))[0]
    assert s["valid_records"] + s["invalid_records"] == s["total_records"] == raw.sessions.count()
    assert quality.dq_flags(raw).filter("is_invalid").count() == s["invalid_records"]
    assert s["warnings"] == len(rows(quality.dq_report(raw)))


def test_peak_and_offpeak_make_the_total(t):
    got = rows(demand.peak_vs_offpeak(t))
    assert sum(r["sessions"] for r in got) == t.sessions.count()


def test_scenario_with_nothing_added_is_the_baseline(t):
    base = {r["station_id"]: r for r in rows(capacity.capacity_baseline(t))}
    for r in rows(capacity.capacity_scenarios(t, add=(0,))):
        for name in ("utilization_pct", "peak_day_utilization_pct", "queue_proxy", "sessions_per_charger", "cpi"):
            assert r[f"scenario_{name}"] == base[r["station_id"]][name]
            assert r[f"{name}_change"] == 0
        assert r["scenario_revenue_capacity"] == pytest.approx(base[r["station_id"]]["revenue_capacity"])


def test_scenarios_of_some_stations(t):
    wanted = t.stations.filter("station_type = 'Urban'")
    ids = [r["station_id"] for r in rows(wanted)]
    by_list = rows(capacity.capacity_scenarios(t, add=(1, 20), station_ids=ids), "station_id", "added")
    by_join = rows(capacity.capacity_scenarios(t, add=(1, 20), station_ids=wanted), "station_id", "added")
    assert by_list == by_join and len(by_list) == 2 * len(ids)


def test_report_and_page_agree_on_vehicles(t):
    page = {r["vehicle_type"]: r for r in rows(customer.vehicle_intelligence(t))}
    for r in rows(reports.sql11_vehicle_analysis(t)):
        mine = page[r["vehicle_type"]]
        assert (r["total_sessions"], r["total_revenue"]) == (mine["sessions"], mine["revenue"])
        assert r["avg_duration_minutes"] == mine["avg_duration"]


def test_report_and_page_agree_on_totals(t):
    report, page = rows(reports.sql01_network_kpis(t))[0], rows(revenue.revenue_kpis(t))[0]
    assert report["total_revenue_usd"] == page["total_revenue"] == rows(net.landing_kpis(t))[0]["total_revenue"]
    assert report["avg_revenue_per_session"] == page["avg_transaction_value"]


def test_hours_agree(t):
    a = {r["hour"]: r["sessions"] for r in rows(net.sessions_by_hour(t))}
    b = {r["hour_of_day"]: r["total_sessions"] for r in rows(reports.sql04_hourly_demand(t))}
    heat = {}
    for r in rows(demand.demand_heatmap(t)):
        heat[r["hour"]] = heat.get(r["hour"], 0) + r["sessions"]
    assert a == b == heat


def test_no_station_selected_means_all(t):
    assert noc.noc_station_filter(t).count() == t.sessions.count()
    assert noc.noc_station_filter(t, [1, 2]).count() == t.sessions.filter("station_id in (1, 2)").count()
