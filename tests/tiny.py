"""Hand-made tables with the library's own types."""

from __future__ import annotations

import datetime as dt

from voltlake.sources.tables import CHARGERS, SESSIONS, STATIONS, Tables

DAY = dt.datetime(2025, 3, 3)  # a Monday


def station(i, area="A", total=2, **kw):
    row = dict(
        station_id=f"S{i}", station_name=f"Station {i}", city=f"City {area}", area=area,
        latitude=1.0, longitude=2.0, total_chargers=total, station_type="Urban",
    )
    return {**row, **kw}


def charger(i, station_id, status="Active", **kw):
    row = dict(
        charger_id=f"C{i}", station_id=station_id, charger_type="Level 2 (AC)", power_kw=11.0,
        installation_date=dt.date(2023, 1, 1), charger_status=status,
    )
    return {**row, **kw}


def session(i, station_id="S1", charger_id="C1", day=0, hour=8, minutes=60, energy=10.0, revenue=5.0, **kw):
    start = DAY + dt.timedelta(days=day, hours=hour)
    row = dict(
        session_id=f"X{i}", station_id=station_id, charger_id=charger_id, customer_id="K1",
        vehicle_type="V1", start_time=start, end_time=start + dt.timedelta(minutes=minutes),
        duration_minutes=minutes, energy_kwh=energy, price_per_kwh=0.5, revenue=revenue,
        session_status="Completed", payment_status="Paid",
    )
    return {**row, **kw}


def tables(spark, stations, chargers, sessions) -> Tables:
    def frame(rows, schema):
        return spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema)

    return Tables(frame(stations, STATIONS), frame(chargers, CHARGERS), frame(sessions, SESSIONS))


def rows(df, *keys):
    out = [r.asDict() for r in df.collect()]
    return sorted(out, key=lambda r: tuple(str(r[k]) for k in keys)) if keys else out
