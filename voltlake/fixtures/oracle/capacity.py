"""Capacity baseline and scenarios."""

from voltlake.fixtures.oracle.base import statement

LOAD = """
SELECT p.station_id, p.station_name, p.sessions, p.minutes, p.revenue, p.failure_rate_pct,
  greatest(p.active_chargers, 1) AS chargers, CAST(span24.days AS BIGINT) AS days24,
  CASE WHEN b.busiest IS NULL THEN 0.0 ELSE b.busiest / b.mean_hour END AS peak_ratio,
  coalesce(k.peak, 0) AS peak_minutes
FROM perf p CROSS JOIN span24 LEFT JOIN byhour b ON b.station_id = p.station_id
LEFT JOIN (SELECT station_id, max(m) AS peak FROM (SELECT station_id, d, CAST(sum(duration_minutes) AS BIGINT) AS m FROM ses GROUP BY 1, 2) GROUP BY 1) k
  ON k.station_id = p.station_id
"""

# Figures for the station's chargers (0 added) and for more of them.
FIGURES = """
SELECT *, CAST(trunc(least(100.0, util / 25.0 * 100.0) * 0.35::DOUBLE + least(100.0, peak_ratio / 3.0 * 100.0) * 0.25::DOUBLE
  + least(100.0, queue / 10.0 * 100.0) * 0.2::DOUBLE + least(100.0, failure_rate_pct / 5.0 * 100.0) * 0.2::DOUBLE) AS BIGINT) AS cpi,
  CASE WHEN base_util > 0 THEN revenue / (base_util / 100.0) ELSE 0.0 END * (total::DOUBLE / chargers) AS capacity
FROM (SELECT l.*, a.added, l.chargers + a.added AS total,
    l.minutes::DOUBLE / ((l.chargers + a.added) * l.days24 * 1440)::DOUBLE * 100.0 AS util,
    l.minutes::DOUBLE / (l.chargers * l.days24 * 1440)::DOUBLE * 100.0 AS base_util,
    l.peak_minutes::DOUBLE / ((l.chargers + a.added) * 1440)::DOUBLE * 100.0 AS peak_util,
    l.sessions::DOUBLE / ((l.chargers + a.added) * l.days24)::DOUBLE AS queue,
    l.sessions::DOUBLE / (l.chargers + a.added) AS per_charger
  FROM load l, (SELECT unnest(range(0, 6)) AS added) a)
"""
STEPS = {"load": LOAD, "figures": FIGURES}

SQL = {
    "capacity_baseline": statement(
        """
SELECT station_id, station_name, chargers, util AS utilization_pct, peak_util AS peak_day_utilization_pct,
  queue AS queue_proxy, per_charger AS sessions_per_charger, failure_rate_pct, capacity AS revenue_capacity, cpi
FROM figures WHERE added = 0
""",
        **STEPS,
    ),
    "capacity_scenarios": statement(
        """
SELECT s.station_id, s.station_name, s.added, s.total AS scenario_chargers, s.util AS scenario_utilization_pct,
  s.peak_util AS scenario_peak_day_utilization_pct, s.queue AS scenario_queue_proxy,
  s.per_charger AS scenario_sessions_per_charger, s.cpi AS scenario_cpi, s.capacity AS scenario_revenue_capacity,
  s.util - b.util AS utilization_pct_change, s.peak_util - b.peak_util AS peak_day_utilization_pct_change,
  s.queue - b.queue AS queue_proxy_change, s.per_charger - b.per_charger AS sessions_per_charger_change,
  s.cpi - b.cpi AS cpi_change, s.capacity - b.capacity AS revenue_capacity_change
FROM figures s JOIN figures b ON b.station_id = s.station_id AND b.added = 0 WHERE s.added > 0
""",
        **STEPS,
    ),
}
