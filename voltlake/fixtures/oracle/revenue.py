"""Revenue KPIs, matrix and breakdowns."""

from voltlake.fixtures.oracle.base import statement

TOTALS = """
SELECT {sum:revenue} AS r, {sum:energy_kwh} AS e, count(*) AS n, count(*) FILTER (session_status = 'Completed') AS done,
  count(DISTINCT charger_id) AS c, count(DISTINCT station_id) AS s, CAST(sum(duration_minutes) AS BIGINT) / 60.0::DOUBLE AS hrs
FROM sessions
"""

MATRIX = """
SELECT s.station_id, t.station_name, {sum:revenue} AS revenue, CAST(sum(s.duration_minutes) AS BIGINT) AS minutes,
  count(DISTINCT s.charger_id) AS chargers_seen,
  CAST(sum(s.duration_minutes) AS BIGINT)::DOUBLE / (count(DISTINCT s.charger_id) * max(span.days) * 1440) * 100.0 AS utilization_pct
FROM ses s JOIN stations t ON t.station_id = s.station_id, span GROUP BY 1, 2
"""


def _by(key: str, name: str, source: str = "ses", tail: str = "") -> str:
    return statement(f"SELECT {key} AS {name}, {{sum:revenue}} AS revenue FROM {source} GROUP BY 1 {tail}")


BY_STATION = "ses s JOIN stations t ON t.station_id = s.station_id"

SQL = {
    "revenue_kpis": statement(
        """
SELECT r AS total_revenue, e AS total_energy_kwh, n AS total_sessions, done AS completed_sessions, c AS chargers_seen,
  s AS stations_seen, r / n AS revenue_per_session, r / done AS avg_transaction_value, r / e AS revenue_per_kwh,
  r / c AS revenue_per_charger, r / s AS revenue_per_station, r / hrs AS revenue_per_operating_hour FROM totals
""",
        totals=TOTALS,
    ),
    "revenue_quadrants": statement(
        """
SELECT x.*, CASE WHEN utilization_pct >= mu THEN 'High Util' ELSE 'Low Util' END || ' / ' ||
  CASE WHEN revenue >= mr THEN 'High Rev' ELSE 'Low Rev' END AS quadrant
FROM matrix x, (SELECT median(utilization_pct) AS mu, median(revenue) AS mr FROM matrix)
""",
        matrix=MATRIX,
    ),
    "revenue_by_day": _by("d", "date"),
    "revenue_top_stations": _by(
        "t.station_name", "station_name", BY_STATION, "ORDER BY revenue DESC, station_name LIMIT 10"
    ),
    "revenue_by_city": _by("t.city", "city", BY_STATION),
    "revenue_by_charger_type": _by(
        "c.charger_type", "charger_type", "ses s JOIN chargers c ON c.charger_id = s.charger_id"
    ),
    "revenue_by_vehicle": _by("vehicle_type", "vehicle_type"),
    "revenue_by_hour": _by("h", "hour"),
}
