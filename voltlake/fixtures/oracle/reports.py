"""The twelve standing reports."""

from voltlake.fixtures.oracle.base import statement

LOAD = """
SELECT station_id, count(session_id) AS n, CAST(sum(duration_minutes) AS BIGINT) AS mins, {sum:revenue} AS rev,
  {sum:energy_kwh} AS kwh, count(*) FILTER (session_status = 'Failed') AS failed FROM sessions GROUP BY station_id
"""

SQL = {
    "sql01_network_kpis": statement("""
SELECT count(session_id) AS total_sessions, {sum:energy_kwh} AS total_energy_kwh, {sum:revenue} AS total_revenue_usd,
  sum(duration_minutes)::DOUBLE / count(duration_minutes) AS avg_duration_minutes,
  {sum:revenue} / nullif(count(*) FILTER (session_status = 'Completed'), 0) AS avg_revenue_per_session,
  count(*) FILTER (session_status = 'Completed') * 100.0::DOUBLE / nullif(count(session_id), 0) AS network_success_rate
FROM sessions
"""),
    "sql02_station_performance": statement(
        """
SELECT t.station_id, t.station_name, t.city, coalesce(l.n, 0) AS total_sessions, l.rev AS total_revenue,
  l.kwh AS total_energy, l.mins::DOUBLE / l.n AS avg_duration, l.failed * 100.0::DOUBLE / nullif(l.n, 0) AS failure_rate_pct
FROM stations t LEFT JOIN station_load l ON l.station_id = t.station_id
""",
        station_load=LOAD,
    ),
    "sql03_charger_failure": statement("""
SELECT c.charger_id, c.station_id, c.charger_type, count(s.session_id) AS total_attempts,
  count(*) FILTER (s.session_status = 'Failed') AS total_failures,
  count(*) FILTER (s.session_status = 'Failed') * 100.0::DOUBLE / count(s.session_id) AS failure_rate_pct
FROM chargers c LEFT JOIN sessions s ON s.charger_id = c.charger_id GROUP BY 1, 2, 3 HAVING count(s.session_id) > 10
"""),
    "sql04_hourly_demand": statement("""
SELECT h AS hour_of_day, count(session_id) AS total_sessions, {sum:energy_kwh} AS total_energy, {sum:revenue} AS total_revenue
FROM ses GROUP BY h
"""),
    "sql05_daily_demand": statement("""
SELECT CAST(dayofweek(d) + 1 AS BIGINT) AS day_of_week_num, count(session_id) AS total_sessions,
  sum(duration_minutes)::DOUBLE / count(duration_minutes) AS avg_duration, {sum:energy_kwh} AS total_energy FROM ses GROUP BY 1
"""),
    "sql06_monthly_revenue": statement("""
SELECT mon AS billing_month, n AS total_sessions, CAST(rev AS DOUBLE) AS gross_revenue_usd,
  CAST(sum(rev) OVER (ORDER BY mon) AS DOUBLE) AS cumulative_revenue_usd
FROM (SELECT date_trunc('month', start_time) AS mon, count(session_id) AS n, sum(CAST(revenue AS DECIMAL(18,4))) AS rev
  FROM sessions GROUP BY 1)
"""),
    "sql07_top_stations": statement(
        """
SELECT station_name, city, total_revenue, revenue_rank
FROM (SELECT t.station_id, t.station_name, t.city, l.rev AS total_revenue, rank() OVER (ORDER BY l.rev DESC) AS revenue_rank
  FROM station_load l JOIN stations t ON t.station_id = l.station_id)
ORDER BY revenue_rank, station_id LIMIT 10
""",
        station_load=LOAD,
    ),
    "sql08_underutilized": statement(
        """
SELECT t.station_name, t.city, a.n AS active_chargers, l.n AS total_sessions,
  l.mins::DOUBLE / (a.n * 525600) * 100.0 AS est_utilization_pct
FROM stations t JOIN act a ON a.station_id = t.station_id LEFT JOIN station_load l ON l.station_id = t.station_id
WHERE l.mins::DOUBLE / (a.n * 525600) * 100.0 < 2.0
""",
        station_load=LOAD,
    ),
    "sql09_high_pressure": statement(
        """
SELECT t.station_name, t.city, a.n AS active_chargers, l.n AS total_sessions,
  l.n::DOUBLE / (a.n * 365) AS sessions_per_charger_per_day
FROM stations t JOIN act a ON a.station_id = t.station_id JOIN station_load l ON l.station_id = t.station_id
WHERE l.n::DOUBLE / (a.n * 365) > 0.3
""",
        station_load=LOAD,
    ),
    "sql10_customer_buckets": statement("""
SELECT CASE WHEN v = 1 THEN 'Single Use' WHEN v BETWEEN 2 AND 5 THEN 'Occasional (2-5)'
    WHEN v BETWEEN 6 AND 20 THEN 'Regular (6-20)' ELSE 'Power User (21+)' END AS customer_segment,
  count(customer_id) AS customer_count, CAST(sum(v) AS BIGINT) AS total_network_visits
FROM (SELECT customer_id, count(session_id) AS v FROM sessions GROUP BY 1) GROUP BY 1
"""),
    "sql11_vehicle_analysis": statement("""
SELECT vehicle_type, count(session_id) AS total_sessions, {sum:energy_kwh} AS total_energy_kwh,
  {sum:energy_kwh} / count(energy_kwh) AS avg_kwh_per_session,
  sum(duration_minutes)::DOUBLE / count(duration_minutes) AS avg_duration_minutes, {sum:revenue} AS total_revenue
FROM sessions GROUP BY vehicle_type
"""),
    "sql12_anomaly_flags": statement("""
SELECT session_id, station_id, charger_id, CAST(duration_minutes AS BIGINT) AS duration_minutes, energy_kwh,
  CASE WHEN duration_minutes > 240 AND energy_kwh < 2 THEN 'Idle Camper' ELSE 'Immediate Failure/Abort' END AS anomaly_flag
FROM sessions WHERE (duration_minutes > 240 AND energy_kwh < 2) OR (duration_minutes < 5 AND energy_kwh = 0)
"""),
}
