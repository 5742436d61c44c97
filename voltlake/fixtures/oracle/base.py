"""Common table expressions every oracle statement starts from (FIXTURES.md section 2, DuckDB spelling)."""

from __future__ import annotations

import re

NET_ACTIVE = "SELECT count(*) FILTER (charger_status = 'Active') AS active FROM chargers"

CTES = {
    "stations": """
SELECT s_suppkey AS station_id, s_name AS station_name, n_name AS city, r_name AS area,
  CAST(24.5 + (s_suppkey * 37 % 2400) / 100.0 AS DOUBLE) AS latitude,
  CAST(-124.0 + (s_suppkey * 53 % 5700) / 100.0 AS DOUBLE) AS longitude,
  4 + s_suppkey % 16 AS total_chargers,
  CASE s_suppkey % 4 WHEN 0 THEN 'Highway' WHEN 1 THEN 'Urban' WHEN 2 THEN 'Retail' ELSE 'Workplace' END AS station_type
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
    "chargers": """
SELECT station_id * 100 + k AS charger_id, station_id,
  CASE k % 4 WHEN 0 THEN 'Level 2 (AC)' WHEN 1 THEN 'DC Fast (50kW)' WHEN 2 THEN 'DC Ultra-Fast (150kW+)' ELSE 'DC Hyper-Fast (350kW)' END AS charger_type,
  CAST(CASE k % 4 WHEN 0 THEN 11 WHEN 1 THEN 50 WHEN 2 THEN 150 ELSE 350 END AS DOUBLE) AS power_kw,
  CASE WHEN station_id % 25 = 24 THEN 'Offline' WHEN (station_id * 7 + k * 3) % 100 < 90 THEN 'Active'
       WHEN (station_id * 7 + k * 3) % 100 < 97 THEN 'Maintenance' ELSE 'Offline' END AS charger_status
FROM (SELECT station_id, total_chargers, unnest(range(0, total_chargers)) AS k FROM stations) t
""",
    "sessions0": """
SELECT l.l_orderkey * 10 + l.l_linenumber AS session_id, l.l_suppkey AS station_id,
  l.l_suppkey * 100 + l.l_partkey % (4 + l.l_suppkey % 16) AS charger_id,
  o.o_custkey AS customer_id, p.p_brand AS vehicle_type,
  date_diff('day', DATE '1995-01-01', CAST(l.l_shipdate AS DATE)) % 365 AS dd, (l.l_partkey % 12 + l.l_orderkey % 13) AS hh,
  (l.l_orderkey * 7 + l.l_linenumber * 13) % 60 AS mm,
  CAST(l.l_quantity AS INT) AS q, l.l_partkey AS pk, CAST(FLOOR(l.l_extendedprice / 12) AS INT) AS e100,
  (l.l_orderkey * 31 + l.l_partkey * 17 + l.l_linenumber * 7 + l.l_suppkey * 3) % 100 AS u
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
""",
    "sessions1": """
SELECT *,
  CASE WHEN u < 90 THEN 'Completed' WHEN u < 95 THEN 'Failed' WHEN u < 98 THEN 'Cancelled' ELSE 'Abnormal' END AS session_status,
  CASE WHEN u < 90 THEN 10 + q * 9 WHEN u < 98 THEN 1 + q % 9 WHEN pk % 2 = 0 THEN 300 + q * 20 ELSE 5 + q % 10 END AS duration_minutes,
  CASE WHEN u < 90 THEN e100 WHEN u < 98 THEN pk % 8 * 25 WHEN pk % 2 = 0 THEN 100 + pk % 400 ELSE 20000 + q * 600 END AS energy_c,
  30 + pk % 36 AS price_c
FROM sessions0
""",
    "sessions": """
SELECT session_id, station_id, charger_id, customer_id, vehicle_type,
  TIMESTAMP '2024-10-01 00:00:00' + to_days(CAST(dd AS INT)) + to_minutes(CAST(hh * 60 + mm AS INT)) AS start_time,
  TIMESTAMP '2024-10-01 00:00:00' + to_days(CAST(dd AS INT)) + to_minutes(CAST(hh * 60 + mm + duration_minutes AS INT)) AS end_time,
  duration_minutes,
  CAST(energy_c / 100.0 AS DOUBLE) AS energy_kwh, CAST(price_c / 100.0 AS DOUBLE) AS price_per_kwh,
  CAST(CASE WHEN u < 90 THEN energy_c * price_c / 10000.0 ELSE 0 END AS DOUBLE) AS revenue,
  session_status,
  CASE WHEN u < 90 THEN 'Paid' WHEN u < 95 THEN 'Refunded' WHEN u < 98 THEN 'Voided' ELSE 'Pending' END AS payment_status
FROM sessions1
""",
    "sessions_raw": """
SELECT session_id,
  CASE WHEN session_id % 211 = 0 THEN station_id + 100000 WHEN session_id % 227 = 0 THEN station_id + 1 ELSE station_id END AS station_id,
  CASE WHEN session_id % 223 = 0 THEN charger_id + 90000000 ELSE charger_id END AS charger_id,
  customer_id,
  CASE WHEN session_id % 251 = 0 THEN NULL ELSE vehicle_type END AS vehicle_type,
  start_time,
  CASE WHEN session_id % 241 = 0 THEN start_time ELSE end_time END AS end_time,
  CASE WHEN session_id % 239 = 0 THEN 0 ELSE duration_minutes END AS duration_minutes,
  CASE WHEN session_id % 229 = 0 THEN -energy_kwh - 1 ELSE energy_kwh END AS energy_kwh,
  price_per_kwh,
  CASE WHEN session_id % 233 = 0 THEN -revenue - 1 ELSE revenue END AS revenue,
  session_status, payment_status
FROM sessions
""",
    "chargers_raw": """
SELECT charger_id, CASE WHEN charger_id % 97 = 0 THEN station_id + 100000 ELSE station_id END AS station_id,
  charger_type, power_kw, charger_status
FROM chargers
""",
    # Shared steps of several statements.
    "ses": """
SELECT *, CAST(start_time AS DATE) AS d, CAST(hour(start_time) AS BIGINT) AS h,
  dayname(start_time) AS dow, isodow(start_time) - 1 AS wd
FROM sessions
""",
    "span": """
SELECT greatest(date_diff('day', min(d), max(d)), 1) AS days FROM ses
""",
    "span24": """
SELECT greatest(floor(date_diff('second', min(start_time), max(start_time)) / 86400), 1) AS days FROM sessions
""",
    "act": """
SELECT station_id, count(*) AS n FROM chargers WHERE charger_status = 'Active' GROUP BY station_id
""",
    "net": NET_ACTIVE,
    "state": """
SELECT s.station_id, CASE
    WHEN count(c.charger_id) = 0 THEN 'Unknown'
    WHEN count(*) FILTER (c.charger_status = 'Active') = 0 THEN 'Offline'
    WHEN count(*) FILTER (c.charger_status = 'Maintenance') = 0 THEN 'Online'
    ELSE 'Degraded' END AS station_status
FROM stations s LEFT JOIN chargers c ON c.station_id = s.station_id GROUP BY s.station_id
""",
    # Per-station volume and rates of all stations.
    "perf": """
SELECT s.station_id, s.station_name, s.city, s.area, s.station_type, s.latitude, s.longitude,
  CAST(s.total_chargers AS BIGINT) AS total_chargers,
  coalesce(g.n, 0) AS sessions, coalesce(g.rev, 0.0) AS revenue, coalesce(g.kwh, 0.0) AS energy_kwh,
  coalesce(g.mins, 0) AS minutes, coalesce(g.failed, 0) AS failed, coalesce(g.done, 0) AS completed,
  CASE WHEN coalesce(g.n, 0) = 0 THEN 0.0 ELSE g.failed::DOUBLE / g.n::DOUBLE * 100.0 END AS failure_rate_pct,
  CASE WHEN coalesce(g.done, 0) > 0 THEN g.mins::DOUBLE / g.done WHEN coalesce(g.mins, 0) > 0 THEN 'Infinity'::DOUBLE ELSE 0.0 END AS avg_session_duration,
  CASE WHEN coalesce(g.done, 0) > 0 THEN g.rev / g.done WHEN coalesce(g.rev, 0) > 0 THEN 'Infinity'::DOUBLE ELSE 0.0 END AS avg_revenue_per_session,
  coalesce(a.n, 0) AS active_chargers,
  CASE WHEN coalesce(a.n, 0) = 0 THEN 0.0 ELSE coalesce(g.mins, 0)::DOUBLE / (a.n * span.days * 1440)::DOUBLE * 100.0 END AS utilization_pct,
  span.days AS days
FROM stations s CROSS JOIN span
LEFT JOIN (SELECT station_id, count(session_id) AS n, {sum:revenue} AS rev, {sum:energy_kwh} AS kwh,
    CAST(sum(duration_minutes) AS BIGINT) AS mins, count(*) FILTER (session_status = 'Failed') AS failed,
    count(*) FILTER (session_status = 'Completed') AS done
  FROM ses GROUP BY station_id) g ON g.station_id = s.station_id
LEFT JOIN act a ON a.station_id = s.station_id
""",
    "byhour": """
SELECT station_id, max(n) AS busiest, sum(n)::DOUBLE / count(*) AS mean_hour
FROM (SELECT station_id, h, count(*) AS n FROM ses GROUP BY station_id, h) GROUP BY station_id
""",
    "cpi": """
SELECT p.*, b.busiest, b.mean_hour,
  CASE WHEN b.busiest IS NULL OR p.active_chargers = 0 THEN 0.0 ELSE least(100.0, p.utilization_pct / 25.0 * 100.0) END AS pu,
  CASE WHEN b.busiest IS NULL OR p.active_chargers = 0 THEN 0.0 ELSE least(100.0, b.busiest / b.mean_hour / 3.0 * 100.0) END AS pp,
  CASE WHEN b.busiest IS NULL OR p.active_chargers = 0 THEN 0.0 ELSE least(100.0, p.sessions::DOUBLE / (p.active_chargers * p.days)::DOUBLE / 10.0 * 100.0) END AS pq,
  CASE WHEN b.busiest IS NULL OR p.active_chargers = 0 THEN 0.0 ELSE least(100.0, p.failure_rate_pct / 5.0 * 100.0) END AS pf
FROM perf p LEFT JOIN byhour b ON b.station_id = p.station_id
""",
    "idx": """
SELECT *, CAST(trunc(pu) AS BIGINT) AS util_pressure, CAST(trunc(pp) AS BIGINT) AS peak_pressure,
  CAST(trunc(pq) AS BIGINT) AS queue_pressure, CAST(trunc(pf) AS BIGINT) AS fail_pressure,
  CAST(trunc(ix) AS BIGINT) AS cpi,
  CASE WHEN ix <= 25 THEN 'Low Pressure' WHEN ix <= 50 THEN 'Moderate Pressure' WHEN ix <= 75 THEN 'High Pressure' ELSE 'Critical Pressure' END AS cpi_category
FROM (SELECT *, pu * 0.35::DOUBLE + pp * 0.25::DOUBLE + pq * 0.2::DOUBLE + pf * 0.2::DOUBLE AS ix FROM cpi)
""",
}


def _expand(sql: str) -> str:
    """{sum:x}: order-independent sum of money or energy as DOUBLE."""
    return re.sub(r"\{sum:(\w+)\}", r"CAST(sum(CAST(\1 AS DECIMAL(18,4))) AS DOUBLE)", sql)


def _needed(sql: str, extra: dict[str, str]) -> list[str]:
    """Names of the expressions a statement uses, in definition order."""
    known = {**CTES, **extra}
    found: set[str] = set()
    queue = [sql]
    while queue:
        text = queue.pop()
        for name in known:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                queue.append(known[name])
    return [n for n in known if n in found]


def statement(body: str, **extra: str) -> str:
    """A full statement: WITH the expressions it needs, then the body.

    ``extra`` are expressions of the statement itself; they may use the common
    ones and those given before them.
    """
    known = {**CTES, **extra}
    names = _needed(body, extra)
    ctes = ",\n".join(f"{n} AS ({_expand(known[n]).strip()})" for n in names)
    return f"WITH {ctes}\n{_expand(body).strip()}"


def filtered(sql: str, where: str) -> str:
    """A full statement whose sessions are only those that ``where`` lets through."""
    whole = CTES["sessions"].strip()
    if f"sessions AS ({whole})" not in sql:
        raise ValueError("the statement reads no sessions")
    return sql.replace(f"sessions AS ({whole})", f"sessions AS (SELECT * FROM ({whole}) WHERE {where})", 1)
