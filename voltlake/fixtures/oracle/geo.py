"""Station metrics with coordinates, area summary."""

from voltlake.fixtures.oracle.base import statement

GEO = """
SELECT station_id, station_name, city, area, latitude, longitude, sessions, revenue, utilization_pct, failure_rate_pct, cpi
FROM idx
"""
AREA = """
SELECT area, count(station_id) AS stations, CAST(sum(sessions) AS BIGINT) AS sessions,
  round(avg(utilization_pct), 6) AS avg_utilization_pct, round(avg(cpi), 6) AS avg_cpi,
  round(avg(failure_rate_pct), 6) AS avg_failure_rate_pct
FROM idx GROUP BY area
"""

SQL = {
    "geo_metrics": statement(GEO),
    "geo_threshold_filter": statement(
        "SELECT * FROM geo WHERE utilization_pct >= 3 AND revenue >= 9000 AND failure_rate_pct >= 4 AND cpi >= 30",
        geo=GEO,
    ),
    "area_summary": statement(AREA),
    "area_high_demand": statement("SELECT * FROM areas ORDER BY sessions DESC, area LIMIT 3", areas=AREA),
    "area_high_pressure": statement(
        "SELECT * FROM areas WHERE avg_cpi > 30 ORDER BY avg_cpi DESC, area", areas=AREA
    ),
    "area_underutilized": statement(
        "SELECT * FROM areas WHERE avg_utilization_pct < 4 ORDER BY avg_utilization_pct, area", areas=AREA
    ),
    "area_risk": statement(
        "SELECT * FROM areas WHERE avg_failure_rate_pct > 3 ORDER BY avg_failure_rate_pct DESC, area",
        areas=AREA,
    ),
}
