"""Landing page, period metrics, health, trends, alerts."""

from voltlake.fixtures.oracle.base import statement

LAST = "SELECT max(start_time) AS t FROM sessions"

WINDOWS = """
SELECT 'current' AS period, s.* FROM ses s, last WHERE s.start_time > last.t - INTERVAL 30 DAY
UNION ALL
SELECT 'previous', s.* FROM ses s, last
WHERE s.start_time > last.t - INTERVAL 60 DAY AND s.start_time <= last.t - INTERVAL 30 DAY
"""

PERIODS = """
SELECT p.period, g.total_sessions, g.total_energy_kwh, g.total_revenue,
  g.done_minutes::DOUBLE / g.done AS avg_duration_minutes, g.done_kwh / g.done AS avg_energy_kwh,
  g.failed::DOUBLE / g.total_sessions * 100.0 AS failure_rate_pct,
  g.minutes / 60.0::DOUBLE / (net.active * g.days * 24) * 100.0 AS utilization_pct,
  (SELECT count(*) FROM stations WHERE station_id IN (SELECT station_id FROM act)) AS active_stations,
  net.active AS active_chargers
FROM (VALUES ('current'), ('previous')) p(period) CROSS JOIN net
JOIN (SELECT period, count(*) AS total_sessions, {sum:energy_kwh} AS total_energy_kwh, {sum:revenue} AS total_revenue,
    count(*) FILTER (session_status = 'Completed') AS done,
    sum(duration_minutes) FILTER (session_status = 'Completed') AS done_minutes,
    CAST(sum(CAST(energy_kwh AS DECIMAL(18,4))) FILTER (session_status = 'Completed') AS DOUBLE) AS done_kwh,
    count(*) FILTER (session_status = 'Failed') AS failed, CAST(sum(duration_minutes) AS BIGINT) AS minutes,
    greatest(CAST(floor(date_diff('second', min(start_time), max(start_time)) / 86400) AS BIGINT), 1) AS days
  FROM windows GROUP BY period) g ON g.period = p.period
"""

STATION30 = """
SELECT g.station_id, g.total_sessions, g.failed_sessions, g.minutes, coalesce(a.n, 0) AS active_chargers,
  g.failed_sessions::DOUBLE / g.total_sessions * 100.0 AS failure_rate_pct,
  CASE WHEN coalesce(a.n, 0) > 0 THEN g.minutes::DOUBLE / (a.n * 43200) * 100.0
       WHEN g.minutes > 0 THEN 'Infinity'::DOUBLE END AS utilization_pct
FROM (SELECT station_id, count(session_id) AS total_sessions,
    count(*) FILTER (session_status = 'Failed') AS failed_sessions, CAST(sum(duration_minutes) AS BIGINT) AS minutes
  FROM windows WHERE period = 'current' GROUP BY station_id) g
LEFT JOIN act a ON a.station_id = g.station_id
"""

W = {"last": LAST, "windows": WINDOWS}
P = {**W, "periods": PERIODS}
S = {**W, "station30": STATION30}

METRICS = (
    "total_sessions", "total_energy_kwh", "total_revenue", "avg_duration_minutes", "avg_energy_kwh",
    "failure_rate_pct", "utilization_pct", "active_stations", "active_chargers",
)

PAIRS = "\nUNION ALL\n".join(
    f"SELECT '{x}' AS metric, c.{x}::DOUBLE AS cur, p.{x}::DOUBLE AS prev"
    " FROM periods c, periods p WHERE c.period = 'current' AND p.period = 'previous'"
    for x in METRICS
)


def _alert(columns: str, where: str) -> str:
    return statement(
        f"""
SELECT h.station_id, t.station_name, {columns}, count(*) OVER () AS total_alerts
FROM station30 h JOIN stations t ON t.station_id = h.station_id WHERE {where}
ORDER BY h.station_id
""",
        **S,
    )


SQL = {
    "landing_kpis": statement("""
SELECT (SELECT count(*) FROM stations) AS total_stations, count(*) AS total_sessions,
  {sum:revenue} AS total_revenue, {sum:energy_kwh} AS total_energy_kwh FROM sessions
"""),
    "period_metrics": statement("SELECT * FROM periods", **P),
    "period_comparison": statement(
        """
SELECT metric, cur AS current_value, prev AS previous_value, pct AS pct_change,
  CASE WHEN pct > 0 THEN 'up' WHEN pct < 0 THEN 'down' ELSE 'flat' END AS direction,
  CASE WHEN pct = 0 THEN 'neutral' WHEN (pct > 0) = (metric <> 'failure_rate_pct') THEN 'good' ELSE 'bad' END AS assessment
FROM (SELECT *, CASE WHEN prev = 0 THEN 0.0 ELSE (cur - prev) / prev * 100.0 END AS pct FROM pairs)
""",
        **P, pairs=PAIRS,
    ),
    "health_score": statement(
        """
SELECT *, CASE WHEN health_score >= 90 THEN 'EXCELLENT' WHEN health_score >= 75 THEN 'FAIR' ELSE 'CRITICAL' END AS health_status
FROM (SELECT *, greatest(0.0, 100.0::DOUBLE - failure_penalty - utilization_penalty - offline_penalty) AS health_score
  FROM (SELECT failure_rate_pct, utilization_pct, failure_rate_pct * 5.0 AS failure_penalty,
      CASE WHEN utilization_pct > 80 THEN utilization_pct - 80.0 WHEN utilization_pct < 2 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS utilization_penalty,
      (SELECT count(*) FILTER (charger_status = 'Offline')::DOUBLE / count(*) * 100.0 FROM chargers) AS offline_penalty
    FROM periods WHERE period = 'current'))
""",
        **P,
    ),
    "daily_trend": statement(
        """
SELECT s.d AS date, {sum:revenue} AS revenue, {sum:energy_kwh} AS energy_kwh, count(s.session_id) AS sessions,
  CAST(sum(s.duration_minutes) AS BIGINT) AS minutes,
  CAST(sum(s.duration_minutes) AS BIGINT)::DOUBLE / (max(net.active) * 1440) * 100.0 AS utilization_pct
FROM ses s CROSS JOIN net CROSS JOIN last WHERE s.start_time >= last.t - INTERVAL 90 DAY GROUP BY s.d
""",
        **W,
    ),
    "sessions_by_hour": statement("SELECT h AS hour, count(*) AS sessions FROM ses GROUP BY h"),
    "sessions_by_dow": statement("SELECT dow AS day_of_week, count(*) AS sessions FROM ses GROUP BY dow"),
    "station_30d": statement("SELECT * FROM station30", **S),
    "alert_high_failure": _alert("failure_rate_pct, failed_sessions", "h.failure_rate_pct > 3"),
    "alert_overloaded": _alert("utilization_pct", "h.utilization_pct > 2"),
    "alert_underutilized": _alert(
        "utilization_pct, active_chargers", "h.utilization_pct < 2 AND h.active_chargers > 0"
    ),
    "alert_abnormal_chargers": statement(
        """
SELECT g.station_id, t.station_name, g.charger_id, g.incidents, count(*) OVER () AS total_alerts
FROM (SELECT station_id, charger_id, count(*) AS incidents FROM windows
  WHERE period = 'current' AND session_status = 'Abnormal' GROUP BY station_id, charger_id) g
JOIN stations t ON t.station_id = g.station_id ORDER BY g.incidents DESC, g.station_id, g.charger_id
""",
        **W,
    ),
}
