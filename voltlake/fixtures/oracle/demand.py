"""Demand by time, peak windows."""

from voltlake.fixtures.oracle.base import statement

HOURLY = "SELECT h, count(*) AS n FROM ses GROUP BY h"
STATS = "SELECT avg(n) AS mean_n, stddev_samp(n) AS sd_n FROM hourly"
PEAKS = "SELECT hourly.h, hourly.n, mean_n, sd_n FROM hourly, stats WHERE n > mean_n + 1.0 * sd_n"
ALL_PEAKS = {"hourly": HOURLY, "stats": STATS, "peaks": PEAKS}


def _mode(key: str) -> str:
    return f"(SELECT {key} FROM ses WHERE {key} IS NOT NULL GROUP BY {key} ORDER BY count(*) DESC, {key} LIMIT 1)"


SQL = {
    "demand_kpis": statement(f"""
SELECT {_mode('h')} AS peak_hour, {_mode('dow')} AS peak_day, {_mode('station_id')} AS peak_station,
  (SELECT t.city FROM ses s JOIN stations t ON t.station_id = s.station_id GROUP BY t.city ORDER BY count(*) DESC, t.city LIMIT 1) AS peak_city,
  count(*) AS total_sessions,
  count(*) / (date_diff('second', min(start_time), max(start_time)) / 3600.0::DOUBLE) AS avg_sessions_per_hour
FROM ses
"""),
    "peak_hours": statement(
        """
SELECT h AS hour, n AS sessions, round(mean_n, 6) AS mean_volume, round(sd_n, 6) AS sd_volume,
  round(mean_n + sd_n, 6) AS threshold FROM peaks
""",
        **ALL_PEAKS,
    ),
    "peak_windows": statement(
        """
SELECT min(h) AS start_hour, max(h) + 1 AS end_hour, CAST(sum(n) AS BIGINT) AS sessions
FROM (SELECT h, n, h - count(*) OVER (ORDER BY h) AS island FROM peaks) GROUP BY island
""",
        **ALL_PEAKS,
    ),
    "demand_heatmap": statement("SELECT dow AS day_of_week, h AS hour, count(*) AS sessions FROM ses GROUP BY dow, h"),
    "weekday_weekend": statement("""
SELECT CASE WHEN wd < 5 THEN 'Weekday' ELSE 'Weekend' END AS day_type, count(*) AS sessions FROM ses GROUP BY 1
"""),
    "vehicle_demand": statement("SELECT vehicle_type, count(*) AS sessions FROM ses GROUP BY vehicle_type"),
    "monthly_demand": statement("SELECT strftime(d, '%Y-%m') AS month, count(*) AS sessions FROM ses GROUP BY 1"),
    "peak_vs_offpeak": statement(
        """
SELECT CASE WHEN s.peak THEN 'Peak' ELSE 'Off-Peak' END AS "window", count(*) AS sessions,
  {sum:energy_kwh} AS energy_kwh, {sum:revenue} AS revenue,
  sum(duration_minutes)::DOUBLE / (max(net.active) * max(span.days) * (CASE WHEN s.peak THEN max(k.n) ELSE 24 - max(k.n) END) * 60) * 100.0 AS utilization_pct,
  sum(duration_minutes)::DOUBLE / count(*) AS avg_duration_minutes
FROM (SELECT *, h IN (SELECT h FROM peaks) AS peak FROM ses) s, net, span, (SELECT count(*) AS n FROM peaks) k
GROUP BY s.peak
""",
        **ALL_PEAKS,
    ),
}
