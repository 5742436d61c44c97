"""Readers, writer, filter and facets."""

from __future__ import annotations

import datetime as dt

import pytest

from conftest import TESTDATA
from tiny import charger, rows, session, station, tables
from voltlake import ALL, GlobalFilter, load_raw_tables, load_tables, write_tables
from voltlake.fixtures.mapping import network
from voltlake.operators import charger as charger_operators, model, network as net, quality, station as stn
from voltlake.sources.filters import filtered_sessions, last_start
from voltlake.sources.tables import Tables, broadcast_if_small


@pytest.fixture(scope="module")
def small(spark):
    stations = [station(1), station(2, area="B")]
    chargers = [charger(1, "S1"), charger(2, "S2", charger_type="DC Fast (50kW)")]
    sessions = [
        session(1), session(2, "S2", "C2", day=40, vehicle_type="V2"),
        session(3, day=41, session_status="Failed"), session(4, "S9", "C9", day=2),
    ]
    return tables(spark, stations, chargers, sessions)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_round_trip(spark, small, tmp_path, fmt):
    write_tables(small, str(tmp_path), fmt)
    back = load_tables(spark, str(tmp_path), fmt)
    for a, b, key in zip((small.stations, small.chargers, small.sessions),
                         (back.stations, back.chargers, back.sessions), ("station_id", "charger_id", "session_id")):
        b = b.drop("start_month")
        assert a.schema.simpleString() == b.schema.simpleString()
        assert rows(a, key) == rows(b, key)
    assert rows(stn.station_performance(back), "station_id") == rows(stn.station_performance(small), "station_id")


def test_writing_twice_needs_a_mode(small, tmp_path):
    write_tables(small, str(tmp_path))
    with pytest.raises(Exception, match="exist"):
        write_tables(small, str(tmp_path))
    write_tables(small, str(tmp_path), mode="overwrite")


HEADERS = {
    "stations": "station_id,station_name,city,area,latitude,longitude,total_chargers,station_type\nS1,N,C,A,1.0,2.0,3,Urban\n",
    "chargers": "charger_id,station_id,charger_type,power_kw,installation_date,charger_status\nC1,S1,L2,11,2023-01-01,Active\n",
}


def _broken(tmp_path):
    for name, text in HEADERS.items():
        (tmp_path / f"{name}.csv").write_text(text)
    head = ("session_id,station_id,charger_id,customer_id,vehicle_type,start_time,end_time,duration_minutes,"
            "energy_kwh,price_per_kwh,revenue,session_status,payment_status\n")
    good = "X1,S1,C1,K1,V,2025-01-01 10:00:00,2025-01-01 11:00:00,60,5.5,0.5,2.75,Completed,Paid\n"
    bad = "X2,S1,C1,K1,V,not a time,2025-01-01 11:00:00,60,5.5,0.5,2.75,Completed,Paid\n"
    hollow = "X3,S1,C1,K1,,2025-01-01 12:00:00,2025-01-01 11:00:00,60,5.5,0.5,2.75,Completed,Paid\n"
    (tmp_path / "charging_sessions.csv").write_text(head + good + bad + hollow)
    return str(tmp_path)


def test_strict_and_lenient_timestamps(spark, tmp_path):
    path = _broken(tmp_path)
    with pytest.raises(Exception):
        net.daily_trend(load_tables(spark, path)).collect()
    raw = load_raw_tables(spark, path)
    assert raw.sessions.count() == 3
    got = {r["rule"]: r["violations"] for r in rows(quality.dq_report(raw))}
    # The unreadable start is neither missing nor late; the hollow row is both.
    assert got == {"Missing Values": 1, "Invalid Timestamps": 1}


def test_broken_records_are_kept(spark, tmp_path):
    path = _broken(tmp_path)
    with open(f"{path}/charging_sessions.csv", "a") as file:
        file.write("X4,S1,C1,K1,V,2025-01-01 10:00:00,2025-01-01 11:00:00,many,5.5,0.5,2.75,Completed,Paid\nX5,S1\n")
        file.write("X6,S1,C1,K1,V,2025-01-01 10:00:00,2025-01-01 11:00:00,60,5.5,0.5,2.75,Completed,Paid,more\n")
    raw = load_raw_tables(spark, path)
    scan = {r["table_name"]: r for r in rows(quality.raw_scan(raw))}["charging_sessions"]
    assert (scan["rows"], scan["unreadable"], scan["bad_timestamps"], scan["late_sessions"]) == (6, 3, 1, 1)
    assert sorted(r["record"].split(",")[0] for r in rows(quality.unreadable_records(raw))) == ["X4", "X5", "X6"]
    # what could be read of a broken record is there
    assert raw.sessions.filter("session_id = 'X4'").first()["energy_kwh"] == 5.5
    whole = Tables(raw.stations, raw.chargers, raw.sessions.drop("broken_record"))
    assert rows(quality.raw_scan(whole))[-1]["unreadable"] == 0


def ids(df):
    return sorted(r["session_id"] for r in df.collect())


@pytest.mark.parametrize("flt, expected", [
    (ALL, ["X1", "X2", "X3", "X4"]),
    (GlobalFilter(date_from=dt.date(2025, 4, 12)), ["X2", "X3"]),
    (GlobalFilter(date_from=dt.date(2025, 4, 12), date_to=dt.date(2025, 4, 12)), ["X2"]),
    (GlobalFilter(city="City B"), ["X2"]),
    (GlobalFilter(station_id="S1"), ["X1", "X3"]),
    (GlobalFilter(charger_type="Level 2 (AC)"), ["X1", "X3"]),
    (GlobalFilter(vehicle_type="V2"), ["X2"]),
    (GlobalFilter(session_status="Failed", city="City A"), ["X3"]),
])
def test_filter(spark, small, tmp_path, flt, expected):
    assert ids(filtered_sessions(small, flt)) == expected
    assert ids(model.global_filter(small, flt)) == expected
    write_tables(small, str(tmp_path))
    read = spark.read.parquet
    stored = Tables(read(f"{tmp_path}/stations"), read(f"{tmp_path}/chargers"), read(f"{tmp_path}/charging_sessions"))
    assert ids(filtered_sessions(stored, flt)) == expected


def _rows_scanned(df) -> int:
    """Rows the scans of an executed plan gave, subqueries included."""
    df.collect()

    def of(plan):
        name, total = plan.nodeName(), 0
        if name == "AdaptiveSparkPlan":
            return of(plan.executedPlan())
        if name.startswith("Scan parquet"):
            total += plan.metrics().apply("numOutputRows").value()
        if hasattr(plan, "plan") and "QueryStage" in name:
            total += of(plan.plan())
        for children in (plan.children(), plan.subqueries()):
            total += sum(of(children.apply(i)) for i in range(children.size()))
        return total

    return of(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def stored_year(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("year"))
    write_tables(network(spark, f"{TESTDATA}/sf0.001"), path)
    return load_tables(spark, path, "parquet")


def test_date_filter_reads_only_its_months(stored_year):
    every = stored_year.sessions.count()
    late = filtered_sessions(stored_year, GlobalFilter(date_from=dt.date(2025, 8, 1))).select("session_id")
    assert 0 < _rows_scanned(late) < 0.3 * every


def test_window_reads_only_its_months(stored_year):
    """The greatest start is found in the last month; the window adds its own months only."""
    every = stored_year.sessions.count()
    small = 20 * (stored_year.stations.count() + stored_year.chargers.count())
    days = dict(stored_year.sessions.groupBy("start_month").count().collect())
    newest = [days[month] for month in stored_year.months]
    assert sum(newest) == every and len(newest) >= 12
    # the last month for the start, then the months of the window
    assert _rows_scanned(net.station_30d(stored_year)) <= newest[0] + sum(newest[:2]) + small < 0.6 * every + small
    assert _rows_scanned(net.daily_trend(stored_year, 60)) <= newest[0] + sum(newest[:4]) + small
    # the sixth month from the end: the directories after it are not searched
    flt = GlobalFilter(date_to=stored_year.months[5])
    assert _rows_scanned(net.station_30d(stored_year, flt=flt)) <= newest[5] + sum(newest[5:7]) + newest[6] + small


@pytest.fixture(scope="module")
def three_years(spark, tmp_path_factory):
    """One session a month over three years, and one without a start; vehicle V2 in the last month but two, V3 in the first only."""
    vehicles = {0: "V3", 33: "V2"}
    sessions = [session(k, day=31 * k, vehicle_type=vehicles.get(k, "V1")) for k in range(36)]
    sessions.append(session(99, start_time=None, vehicle_type="V4"))
    path = str(tmp_path_factory.mktemp("years"))
    write_tables(tables(spark, [station(1)], [charger(1, "S1")], sessions), path)
    return load_tables(spark, path, "parquet")


@pytest.mark.parametrize("vehicle, position, read", [
    (None, 35, 1), ("V1", 35, 1), ("V2", 33, 13), ("V3", 0, 36), ("V4", None, 36), ("none", None, 36),
])
def test_last_start_walks_the_months_down(spark, three_years, vehicle, position, read):
    flt = GlobalFilter(vehicle_type=vehicle)
    s = filtered_sessions(three_years, flt)
    found = spark.range(1).select(last_start(three_years, s, flt).alias("last"))
    want = None if position is None else session(0, day=31 * position)["start_time"]
    assert found.collect()[0]["last"] == want
    assert len(three_years.months) == 36 and _rows_scanned(found) <= read
    got = rows(net.daily_trend(three_years, 1, flt=flt))
    assert [r["sessions"] for r in got] == ([] if want is None else [1])


def test_window_after_a_filter_without_a_match_in_the_last_month(spark, stored_year):
    early = GlobalFilter(date_to=dt.date(2025, 3, 31))
    plain = network(spark, f"{TESTDATA}/sf0.001")
    for operator in (net.station_30d, net.period_metrics, net.daily_trend, charger_operators.anomaly_revenue_drop):
        got, want = rows(operator(stored_year, flt=early)), rows(operator(plain, flt=early))
        assert sorted(map(str, got)) == sorted(map(str, want)) and (got or operator is charger_operators.anomaly_revenue_drop)


def test_the_filter_restricts_sessions_only(small):
    got = {r["period"]: r for r in rows(net.period_metrics(small, flt=GlobalFilter(city="City B")))}
    assert got["current"]["total_sessions"] == 1 and got["current"]["active_chargers"] == 2


def test_facets(small):
    got = {}
    for r in rows(model.filter_facets(small)):
        got.setdefault(r["facet"], []).append(r["value"])
    assert got == {
        "city": ["City A", "City B"], "station": ["S1", "S2"],
        "charger_type": ["DC Fast (50kW)", "Level 2 (AC)"], "vehicle_type": ["V1", "V2"],
        "session_status": ["Completed", "Failed"], "date_min": ["2025-03-03"], "date_max": ["2025-04-13"],
    }


def test_unmatched_sessions_keep_their_row(small):
    got = {r["session_id"]: r for r in rows(model.enrich_sessions(small))}["X4"]
    assert got["station_name"] is None and got["charger_type"] is None and got["day_of_week"] == "Wednesday"


def test_station_attributes(small):
    assert [r["station_id"] for r in rows(model.station_attribute_filter(small, area="B", status="Online"))] == ["S2"]
    assert rows(model.station_attribute_filter(small, city="City A", station_type="Retail")) == []


def test_broadcast_only_below_the_threshold(spark, small):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    hinted = lambda df: "ResolvedHint (strategy=broadcast)" in df._jdf.queryExecution().analyzed().toString()
    stations = network(spark, f"{TESTDATA}/sf0.001").stations
    assert hinted(stations)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
        plain = small.stations
        assert not hinted(broadcast_if_small(plain, stations, 100))
        t = network(spark, f"{TESTDATA}/sf0.001")
        assert not hinted(t.stations)
        assert len(rows(stn.station_performance(t))) == 10  # the shuffled way gives the same
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
