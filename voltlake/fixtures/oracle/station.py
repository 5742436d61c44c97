"""Station performance, pressure index, profile."""

from voltlake.fixtures.oracle.base import statement

PERFORMANCE = (
    "sessions, revenue, energy_kwh, minutes, failed, completed, failure_rate_pct, avg_session_duration,"
    " avg_revenue_per_session, active_chargers, utilization_pct"
)
INDEX = "util_pressure, peak_pressure, queue_pressure, fail_pressure, cpi, cpi_category"

SQL = {
    "station_performance": statement(f"SELECT station_id, station_name, total_chargers, {PERFORMANCE} FROM perf"),
    "station_cpi": statement(f"SELECT station_id, station_name, {INDEX} FROM idx"),
    "station_profile": statement(
        f"""
SELECT i.station_id, i.station_name, i.city, i.area, i.station_type, x.station_status, i.total_chargers,
  {PERFORMANCE}, {INDEX}, b.busiest_hour, w.busiest_day,
  CASE WHEN i.active_chargers = 0 THEN 0.0 ELSE coalesce(p.peak, 0)::DOUBLE / (i.active_chargers * 1440) * 100.0 END AS peak_day_utilization_pct
FROM idx i JOIN state x ON x.station_id = i.station_id
LEFT JOIN (SELECT station_id, max(m) AS peak FROM (SELECT station_id, d, sum(duration_minutes) AS m FROM ses GROUP BY 1, 2) GROUP BY 1) p
  ON p.station_id = i.station_id
LEFT JOIN (SELECT station_id, h AS busiest_hour FROM (SELECT station_id, h, row_number() OVER (PARTITION BY station_id ORDER BY count(*) DESC, h) AS r FROM ses GROUP BY 1, 2) WHERE r = 1) b
  ON b.station_id = i.station_id
LEFT JOIN (SELECT station_id, dow AS busiest_day FROM (SELECT station_id, dow, row_number() OVER (PARTITION BY station_id ORDER BY count(*) DESC, dow) AS r FROM ses GROUP BY 1, 2) WHERE r = 1) w
  ON w.station_id = i.station_id
"""
    ),
}
