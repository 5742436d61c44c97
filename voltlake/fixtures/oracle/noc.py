"""The operations-center model."""

from voltlake.fixtures.oracle.base import statement

NOC = """
SELECT session_id, station_id, start_time, dow AS day_of_week, h AS hour_of_day,
  duration_minutes / 60.0::DOUBLE AS duration_hrs, energy_kwh, revenue FROM ses
"""
HEALTH = """
SELECT station_id, lat, lon, status, chargers_count, total_sessions, total_energy_kwh, utilization_pct,
  CASE WHEN status = 'Offline' THEN 'Critical (Offline)' WHEN utilization_pct > {hi} THEN 'Overloaded'
       WHEN utilization_pct < 5 THEN 'Underutilized' WHEN status = 'Degraded' THEN 'Risky (Degraded)' ELSE 'Healthy' END AS health_category
FROM (SELECT t.station_id, t.latitude AS lat, t.longitude AS lon, x.station_status AS status, t.total_chargers AS chargers_count,
    coalesce(g.n, 0) AS total_sessions, coalesce(g.e, 0.0) AS total_energy_kwh,
    coalesce(g.n, 0)::DOUBLE / (t.total_chargers * 720) * 100.0 AS utilization_pct
  FROM stations t JOIN state x ON x.station_id = t.station_id
  LEFT JOIN (SELECT station_id, count(session_id) AS n, CAST(sum(CAST(energy_kwh AS DECIMAL(18,4))) AS DOUBLE) AS e FROM sessions GROUP BY 1) g
    ON g.station_id = t.station_id)
"""

SQL = {
    "noc_kpis": statement("""
SELECT count(*) AS total_sessions, {sum:energy_kwh} / 1000.0::DOUBLE AS energy_mwh, {sum:revenue} AS total_revenue,
  (SELECT count(*) FROM state WHERE station_status = 'Online') AS online_stations,
  (SELECT count(*) FROM stations) AS total_stations FROM sessions
"""),
    "noc_daily_energy": statement("""
SELECT CAST(c.day AS DATE) AS date, coalesce(g.e, 0.0) AS energy_kwh
FROM (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS day FROM ses) c
LEFT JOIN (SELECT d, {sum:energy_kwh} AS e FROM ses GROUP BY d) g ON g.d = CAST(c.day AS DATE)
"""),
    "noc_station_filter": statement(
        "SELECT * FROM noc WHERE station_id IN (SELECT station_id FROM stations WHERE station_type = 'Highway')",
        noc=NOC,
    ),
    "noc_station_health": statement(HEALTH.replace("{hi}", "60")),
    "noc_zscore_behavior": statement(
        """
SELECT session_id, station_id, start_time, duration_hrs, energy_kwh, round(dz, 6) AS duration_z, round(ez, 6) AS energy_z,
  CASE WHEN dz < -0.5 AND ez > 2.5 THEN 'Hardware Fault Risk' WHEN dz > 2 AND ez < -1 THEN 'Camper Detected' ELSE 'Normal' END AS behavior
FROM (SELECT n.*, (duration_hrs - md) / sd AS dz, (energy_kwh - me) / se AS ez FROM noc n,
  (SELECT avg(duration_hrs) AS md, stddev_samp(duration_hrs) AS sd, avg(energy_kwh) AS me, stddev_samp(energy_kwh) AS se FROM noc))
""",
        noc=NOC,
    ),
    "noc_expansion": statement(
        """
SELECT station_id, chargers_count, total_sessions, utilization_pct FROM health WHERE health_category = 'Overloaded'
""",
        health=HEALTH.replace("{hi}", "10"),
    ),
}
