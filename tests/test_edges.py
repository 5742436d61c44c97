"""Cases the mapped data does not have: zero chargers, empty periods, ties, NULL keys, split windows."""

from __future__ import annotations

import math

import pytest

from tiny import charger, rows, session, station, tables
from voltlake.operators import (
    capacity, charger as chg, customer, demand, geo, insights, model, network, noc, quality, reports, revenue,
    station as stn,
)


def by(df, key):
    return {r[key]: r for r in rows(df)}


@pytest.fixture(scope="module")
def mixed(spark):
    """S1 used and active; S2 used without active chargers; S3 unused; S4 without chargers."""
    stations = [station(1), station(2), station(3), station(4)]
    chargers = [
        charger(1, "S1"), charger(2, "S1", "Maintenance"), charger(3, "S2", "Offline"), charger(4, "S3"),
        charger(5, "S3", "Offline"),
    ]
    sessions = [
        session(1), session(2, day=1, hour=9), session(3, day=1, hour=9, session_status="Failed", revenue=0.0),
        session(4, "S2", "C3", day=2, session_status="Failed", revenue=0.0, minutes=30),
        session(5, None, None, day=9),
    ]
    return tables(spark, stations, chargers, sessions)


def test_zero_active_chargers_are_zero_on_the_station_page(mixed):
    got = by(stn.station_performance(mixed), "station_id")
    assert got["S2"]["utilization_pct"] == 0.0
    # 9 days: the session without a station counts for the span, but is in no group.
    assert got["S1"]["utilization_pct"] == pytest.approx(180 / (1 * 9 * 1440) * 100)
    assert got["S3"]["sessions"] == 0 and got["S3"]["failure_rate_pct"] == 0.0


def test_zero_active_chargers_are_infinite_in_alerts(mixed):
    got = by(network.station_30d(mixed), "station_id")
    assert got["S2"]["utilization_pct"] == math.inf
    assert by(network.station_30d(mixed, zero_active="exclude"), "station_id")["S2"]["utilization_pct"] is None
    assert [r["station_id"] for r in rows(network.alert_overloaded(mixed, pct=15))] == ["S2"]
    assert "S2" not in by(network.alert_underutilized(mixed, pct=1), "station_id")


def test_no_completed_sessions_gives_infinite_averages(mixed):
    got = by(stn.station_performance(mixed), "station_id")["S2"]
    assert got["avg_session_duration"] == math.inf
    assert got["avg_revenue_per_session"] == 0.0  # 0 over 0


def test_infinite_mean_silences_the_first_finding_and_opens_the_fourth(mixed):
    assert rows(insights.insight_capacity_pressure(mixed)) == []
    assert rows(insights.insight_underutilized(mixed, util=99))[0]["baseline"] == math.inf
    assert len(rows(insights.insight_capacity_pressure(mixed, ratio=0.5, zero_active="exclude"))) == 1


def test_station_status(mixed):
    got = {k: r["station_status"] for k, r in by(model.station_status(mixed), "station_id").items()}
    assert got == {"S1": "Degraded", "S2": "Offline", "S3": "Online", "S4": "Unknown"}


def test_pressure_is_zero_without_active_chargers_or_sessions(mixed):
    got = by(stn.station_cpi(mixed), "station_id")
    assert got["S2"]["cpi"] == 0 and got["S2"]["cpi_category"] == "Low Pressure"
    assert got["S3"]["cpi"] == 0
    assert got["S1"]["fail_pressure"] == 100


def test_capacity_has_no_zero_guard(mixed):
    got = by(capacity.capacity_baseline(mixed), "station_id")
    assert got["S2"]["chargers"] == 1 and got["S2"]["cpi"] > 0
    assert got["S4"]["cpi"] == 0 and got["S4"]["revenue_capacity"] == 0.0


def test_category_follows_the_untruncated_index(spark):
    sessions = [session(1), session(2), session(3, day=1)]
    t = tables(spark, [station(1)], [charger(1, "S1")], sessions)
    # 12.5 % used, peak ratio 1, 3 sessions per charger and day, no failures.
    index = 50 * 0.35 + 100 / 3 * 0.25 + 30 * 0.2
    cut = int(index)
    got = rows(stn.station_cpi(t, cuts=(cut, 90, 95)))[0]
    assert got["cpi"] == cut and got["cpi_category"] == "Moderate Pressure"


def test_busiest_hour_and_day_take_the_smallest_on_a_tie(spark):
    sessions = [session(1, day=0, hour=9), session(2, day=4, hour=7)]  # Monday, Friday
    t = tables(spark, [station(1)], [charger(1, "S1")], sessions)
    got = rows(stn.station_profile(t))[0]
    assert (got["busiest_hour"], got["busiest_day"]) == (7, "Friday")
    kpis = rows(demand.demand_kpis(t))[0]
    assert (kpis["peak_hour"], kpis["peak_day"], kpis["peak_station"]) == (7, "Friday", "S1")


def test_empty_previous_period(spark):
    t = tables(spark, [station(1)], [charger(1, "S1")], [session(1), session(2, day=1)])
    got = by(network.period_metrics(t), "period")
    assert got["previous"]["total_sessions"] == 0 and got["previous"]["total_revenue"] == 0.0
    assert got["previous"]["avg_duration_minutes"] == 0.0 and got["previous"]["utilization_pct"] == 0.0
    changes = by(network.period_comparison(t), "metric")
    assert changes["total_sessions"]["pct_change"] == 0.0 and changes["total_sessions"]["direction"] == "flat"


def test_period_bounds_are_half_open(spark):
    sessions = [session(1, day=0), session(2, day=30), session(3, day=60)]
    t = tables(spark, [station(1)], [charger(1, "S1")], sessions)
    got = by(network.period_metrics(t), "period")
    # (30, 60] holds the last one, (0, 30] the middle one; the first lies on an open end.
    assert (got["current"]["total_sessions"], got["previous"]["total_sessions"]) == (1, 1)
    assert len(rows(network.daily_trend(t, days=30))) == 2  # the trend includes its first moment


def test_no_sessions_at_all(spark):
    t = tables(spark, [station(1)], [charger(1, "S1")], [])
    assert rows(network.landing_kpis(t))[0]["total_revenue"] == 0.0
    assert [r["total_sessions"] for r in rows(network.period_metrics(t))] == [0, 0]
    assert rows(stn.station_profile(t))[0]["cpi"] == 0
    assert rows(revenue.revenue_kpis(t))[0]["revenue_per_kwh"] == 0.0
    assert rows(demand.peak_windows(t)) == [] and rows(noc.noc_daily_energy(t)) == []
    assert rows(chg.charger_stats(t))[0]["failure_rate_pct"] == 0.0
    assert rows(customer.customer_kpis(t))[0]["customers"] == 0
    assert rows(customer.customer_segments(t)) == [] and rows(insights.insights(t)) == []
    assert rows(quality.dq_summary(t))[0]["total_records"] == 0 and rows(quality.dq_report(t)) == []
    # An active charger without sessions is below max(1, ...) sessions.
    assert [r["anomaly_type"] for r in rows(chg.anomaly_log(t))] == ["Abnormally Low Frequency"]


def test_utilization_penalties(spark):
    busy = tables(
        spark, [station(1)], [charger(1, "S1")],
        [session(i, hour=i, minutes=1440) for i in range(3)],
    )
    got = rows(network.health_score(busy))[0]
    assert got["utilization_pct"] == pytest.approx(300.0)
    assert got["utilization_penalty"] == pytest.approx(220.0)
    assert got["health_score"] == 0.0 and got["health_status"] == "CRITICAL"
    idle = tables(spark, [station(1)], [charger(1, "S1")], [session(1, minutes=1), session(2, day=1, minutes=1)])
    assert rows(network.health_score(idle))[0]["health_score"] == 95.0


def test_one_observed_hour_has_no_peak(spark):
    t = tables(spark, [station(1)], [charger(1, "S1")], [session(1), session(2)])
    assert rows(demand.peak_hours(t)) == []
    got = by(demand.peak_vs_offpeak(t), "window")
    assert got["Peak"]["sessions"] == 0 and got["Peak"]["utilization_pct"] == 0.0
    assert got["Off-Peak"]["utilization_pct"] == pytest.approx(120 / (24 * 60) * 100)


def test_peak_windows_split_and_do_not_wrap(spark):
    counts = {h: 1 for h in range(24)} | {0: 20, 8: 20, 9: 20, 23: 20}
    sessions = [session(f"{h}-{i}", hour=h) for h, n in counts.items() for i in range(n)]
    t = tables(spark, [station(1)], [charger(1, "S1")], sessions)
    got = [(r["start_hour"], r["end_hour"]) for r in rows(demand.peak_windows(t))]
    assert got == [(0, 1), (8, 10), (23, 24)]


def test_null_keys_are_in_no_group(spark):
    sessions = [session(1), session(2, vehicle_type=None, station_id=None, charger_id=None, customer_id=None)]
    t = tables(spark, [station(1)], [charger(1, "S1")], sessions)
    assert [r["vehicle_type"] for r in rows(demand.vehicle_demand(t))] == ["V1"]
    assert rows(customer.customer_kpis(t))[0]["customers"] == 1
    assert rows(revenue.revenue_by_city(t))[0]["revenue"] == 5.0
    # The KPI page counts an unknown charger once, the matrix does not.
    assert rows(revenue.revenue_kpis(t))[0]["chargers_seen"] == 2
    assert rows(revenue.revenue_quadrants(t))[0]["chargers_seen"] == 1
    # The reports keep NULL groups, as SQL does.
    assert len(rows(reports.sql11_vehicle_analysis(t))) == 2


def test_low_frequency_and_drops(spark):
    stations, chargers = [station(1)], [charger(i, "S1") for i in range(1, 5)]
    sessions = [session(f"{c}-{d}", charger_id=f"C{c}", day=d, revenue=50.0, minutes=200)
                for c in (1, 2, 3) for d in range(0, 30)]
    # C1 has sessions on 15 of the first 15 dates and on 3 of the last 15.
    first = sessions[0]["start_time"]
    kept = [s for s in sessions if s["charger_id"] != "C1" or (s["start_time"] - first).days < 18]
    t = tables(spark, stations, chargers, kept)
    drops = rows(chg.anomaly_revenue_drop(t))
    assert [(r["charger_id"], r["observed_value"]) for r in drops] == [("C1", "-80.0%")]
    assert drops[0]["timestamp"].hour == 0 and drops[0]["severity"] == "High"
    assert [r["charger_id"] for r in rows(chg.anomaly_util_drop(t))] == ["C1"]
    low = rows(chg.anomaly_low_freq(t, k=0.0))
    assert [r["charger_id"] for r in low] == ["C4"]


def test_long_session_is_not_also_a_camper(spark):
    sessions = [session(i, minutes=60) for i in range(20)] + [session("long", minutes=999, energy=1.0)]
    t = tables(spark, [station(1)], [charger(1, "S1")], sessions)
    got = [r["anomaly_type"] for r in rows(chg.anomaly_log(t)) if "Session" in r["anomaly_type"] or "Camper" in r["anomaly_type"]]
    assert got == ["Unusually Long Session"]
    assert rows(chg.anomaly_camper(t)) == []


def test_failure_bound_has_a_floor(spark):
    chargers = [charger(i, "S1") for i in range(1, 9)]
    sessions = [session(f"{c}-{i}", charger_id=f"C{c}") for c in range(1, 9) for i in range(20)]
    sessions[0]["session_status"] = "Failed"
    t = tables(spark, [station(1)], chargers, sessions)
    got = rows(chg.anomaly_high_failure(t))
    assert [(r["charger_id"], r["expected_range"]) for r in got] == [("C1", "<= 2.0%")]


def test_no_severity_selected_gives_no_rows(mixed):
    assert rows(chg.anomaly_log_by_severity(mixed, severities=())) == []


def test_single_use_customers(spark):
    sessions = [session(1, customer_id="A"), session(2, customer_id="B"), session(3, customer_id="B")]
    t = tables(spark, [station(1)], [charger(1, "S1")], sessions)
    got = by(reports.sql10_customer_buckets(t), "customer_segment")
    assert got["Single Use"]["customer_count"] == 1 and got["Occasional (2-5)"]["total_network_visits"] == 2
    assert rows(customer.customer_kpis(t))[0]["repeat_rate_pct"] == 50.0


def test_failure_finding_prefers_revenue_on_a_tie(spark):
    stations = [station(i) for i in range(1, 6)]
    chargers = [charger(i, f"S{i}") for i in range(1, 6)]
    sessions = [session(f"ok{i}", f"S{i}", f"C{i}") for i in range(3, 6)]
    sessions += [session("f1", "S1", "C1", session_status="Failed", revenue=1.0),
                 session("f2", "S2", "C2", session_status="Failed", revenue=9.0)]
    got = rows(insights.insight_failure(tables(spark, stations, chargers, sessions)))
    assert got[0]["subject"] == "Station 2"


def test_quality_rules_on_null_and_unknown_keys(spark):
    stations, chargers = [station(1), station(2)], [charger(1, "S1"), charger(2, "S9")]
    sessions = [
        session(1),
        session(2), session(2),                                    # duplicates
        session(3, station_id=None),                               # missing, unknown, inconsistent
        session(4, station_id="S2"),                               # inconsistent
        session(5, charger_id="C7"),                               # unknown charger
        session(0, session_id=None), session(0, session_id=None),                              # missing and duplicate
        session(6, minutes=0, end_time=session(6)["start_time"]),  # duration, timestamps
        session(7, energy=-1.0, revenue=-1.0),
        session(8, end_time=None),                                 # missing; a NULL end is no timestamp violation
    ]
    t = tables(spark, stations, chargers, sessions)
    got = {r["rule"]: r["violations"] for r in rows(quality.dq_report(t))}
    assert got == {
        "Missing Values": 4, "Duplicate Sessions": 4, "Invalid Timestamps": 1, "Negative Energy": 1,
        "Negative Revenue": 1, "Impossible Durations": 1, "Invalid Station IDs": 1, "Invalid Charger IDs": 1,
        "Orphan Chargers": 1, "Inconsistent Architecture (Relational Mismatch)": 2,
    }
    summary = rows(quality.dq_summary(t))[0]
    assert (summary["total_records"], summary["valid_records"], summary["warnings"]) == (11, 1, 10)
    flags = rows(quality.dq_flags(t))
    assert len(flags) == 11 and sum(r["is_invalid"] for r in flags) == summary["invalid_records"] == 10


def test_areas_without_sessions_still_average(mixed):
    got = rows(geo.area_summary(mixed))[0]
    assert got["stations"] == 4 and got["sessions"] == 4
    assert got["avg_failure_rate_pct"] == pytest.approx((100 / 3 + 100) / 4, abs=1e-6)


def test_rank_ties_share_a_place(spark):
    stations = [station(i) for i in range(1, 4)]
    sessions = [session(1, "S1", revenue=5.0), session(2, "S2", revenue=5.0), session(3, "S3", revenue=1.0)]
    got = rows(reports.sql07_top_stations(tables(spark, stations, [charger(1, "S1")], sessions)))
    assert [(r["station_name"], r["revenue_rank"]) for r in got] == [("Station 1", 1), ("Station 2", 1), ("Station 3", 3)]


def test_calendar_gaps_are_zero(spark):
    t = tables(spark, [station(1)], [charger(1, "S1")], [session(1), session(2, day=3)])
    assert [r["energy_kwh"] for r in rows(noc.noc_daily_energy(t))] == [10.0, 0.0, 0.0, 10.0]


def test_fault_rule_wins_and_health_order(spark):
    stations = [station(1, total=1), station(2, total=1)]
    chargers = [charger(1, "S1", "Offline"), charger(2, "S2"), charger(3, "S2", "Maintenance")]
    sessions = [session(i, "S1") for i in range(500)] + [session(f"b{i}", "S2") for i in range(100)]
    got = {r["station_id"]: r["health_category"] for r in rows(noc.noc_station_health(tables(spark, stations, chargers, sessions)))}
    assert got == {"S1": "Critical (Offline)", "S2": "Risky (Degraded)"}
