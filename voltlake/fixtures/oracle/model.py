"""Enriched sessions, filters, facets, station status, table round trip."""

from voltlake.fixtures.oracle.base import statement

ENRICHED = """
SELECT s.session_id, s.station_id, s.charger_id, s.customer_id, s.vehicle_type, s.start_time, s.end_time,
  s.duration_minutes, s.energy_kwh, s.price_per_kwh, s.revenue, s.session_status, s.payment_status,
  s.d AS date, s.h AS hour, s.dow AS day_of_week, monthname(s.start_time) AS month, s.wd >= 5 AS is_weekend,
  t.station_name, t.city, c.charger_type
FROM ses s LEFT JOIN stations t ON t.station_id = s.station_id LEFT JOIN chargers c ON c.charger_id = s.charger_id
"""

SQL = {
    "enrich_sessions": statement(ENRICHED),
    "global_filter": statement(
        """
SELECT * FROM enriched WHERE date >= DATE '2024-11-15' AND date <= DATE '2025-06-30'
  AND charger_type = 'DC Fast (50kW)' AND session_status = 'Completed'
""",
        enriched=ENRICHED,
    ),
    "filter_facets": statement("""
SELECT 'date_min' AS facet, CAST(min(d) AS VARCHAR) AS value FROM ses
UNION ALL SELECT 'date_max', CAST(max(d) AS VARCHAR) FROM ses
UNION ALL SELECT DISTINCT 'city', city FROM stations
UNION ALL SELECT DISTINCT 'station', CAST(station_id AS VARCHAR) FROM stations
UNION ALL SELECT DISTINCT 'charger_type', charger_type FROM chargers
UNION ALL SELECT DISTINCT 'vehicle_type', vehicle_type FROM sessions
UNION ALL SELECT DISTINCT 'session_status', session_status FROM sessions
"""),
    "station_status": statement(
        "SELECT t.station_id, t.station_name, x.station_status FROM stations t JOIN state x ON x.station_id = t.station_id"
    ),
    "station_attribute_filter": statement("""
SELECT t.station_id, t.station_name, t.city, t.area, t.station_type, t.total_chargers, x.station_status,
  coalesce(a.n, 0) AS active_chargers
FROM stations t JOIN state x ON x.station_id = t.station_id LEFT JOIN act a ON a.station_id = t.station_id
WHERE t.station_type IN ('Urban') AND x.station_status = 'Degraded'
"""),
    "write_tables": statement("""
SELECT 'stations' AS table_name, count(*) AS rows, CAST(sum(total_chargers) AS DOUBLE) AS total FROM stations
UNION ALL SELECT 'chargers', count(*), {sum:power_kw} FROM chargers
UNION ALL SELECT 'charging_sessions', count(*), {sum:energy_kwh} FROM sessions
"""),
}
