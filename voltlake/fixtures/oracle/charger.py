"""Charger statistics and anomaly rules."""

from voltlake.fixtures.oracle.base import statement

MASTER = """
SELECT c.charger_id, c.station_id, c.charger_type, c.power_kw, c.charger_status,
  count(s.session_id) AS n, count(*) FILTER (s.session_status = 'Completed') AS done,
  count(*) FILTER (s.session_status = 'Failed') AS failed, count(*) FILTER (s.session_status = 'Cancelled') AS cut,
  coalesce(CAST(sum(s.duration_minutes) AS BIGINT), 0) AS minutes, {sum:energy_kwh} AS kwh, {sum:revenue} AS rev,
  CASE WHEN count(s.session_id) = 0 THEN 0.0 ELSE count(*) FILTER (s.session_status = 'Failed')::DOUBLE / count(s.session_id) * 100.0 END AS rate
FROM chargers c LEFT JOIN sessions s ON s.station_id = c.station_id AND s.charger_id = c.charger_id
GROUP BY 1, 2, 3, 4, 5
"""

DURATION = """
SELECT quantile_cont(duration_minutes, 0.75) AS q3,
  quantile_cont(duration_minutes, 0.75) + (quantile_cont(duration_minutes, 0.75) - quantile_cont(duration_minutes, 0.25)) * 3.0 AS upper_bound
FROM sessions
"""

LONG = """
SELECT s.start_time AS timestamp, s.charger_id, s.station_id, 'Unusually Long Session' AS anomaly_type,
  'Duration (min)' AS metric, s.duration_minutes::DOUBLE AS observed,
  CAST(CAST(s.duration_minutes AS DECIMAL(18,1)) AS VARCHAR) AS observed_value,
  '<= ' || CAST(CAST(b.upper_bound AS DECIMAL(18,1)) AS VARCHAR) AS expected_range, 'Medium' AS severity
FROM sessions s, bounds b WHERE s.duration_minutes > b.upper_bound
"""

CAMPER = """
SELECT s.start_time AS timestamp, s.charger_id, s.station_id, 'Unusually Low Energy (Camper)' AS anomaly_type,
  'Energy (kWh)' AS metric, s.energy_kwh AS observed,
  CAST(CAST(s.energy_kwh AS DECIMAL(18,2)) AS VARCHAR) AS observed_value, '> 2.0' AS expected_range, 'High' AS severity
FROM sessions s, bounds b WHERE s.duration_minutes > b.q3 AND s.duration_minutes <= b.upper_bound AND s.energy_kwh < 2
"""

FENCES = """
SELECT CASE WHEN f < 1 THEN 2.0 ELSE f END AS fail_bound, freq_hi, greatest(1.0, freq_lo) AS freq_lo,
  (SELECT max(start_time) FROM sessions) AS stamp
FROM (SELECT quantile_cont(rate, 0.75) + (quantile_cont(rate, 0.75) - quantile_cont(rate, 0.25)) * 1.5 AS f,
    quantile_cont(n, 0.75) + (quantile_cont(n, 0.75) - quantile_cont(n, 0.25)) * 1.5 AS freq_hi,
    quantile_cont(n, 0.25) - (quantile_cont(n, 0.75) - quantile_cont(n, 0.25)) * 1.5 AS freq_lo FROM master)
"""

FAILURE = """
SELECT f.stamp AS timestamp, m.charger_id, m.station_id, 'High Failure Rate' AS anomaly_type,
  'Failure Rate (%)' AS metric, m.rate AS observed, CAST(CAST(m.rate AS DECIMAL(18,1)) AS VARCHAR) || '%' AS observed_value,
  '<= ' || CAST(CAST(f.fail_bound AS DECIMAL(18,1)) AS VARCHAR) || '%' AS expected_range, 'High' AS severity
FROM master m, fences f WHERE m.rate > f.fail_bound AND m.n > 15
"""

HIGH_FREQ = """
SELECT f.stamp AS timestamp, m.charger_id, m.station_id, 'Abnormally High Frequency' AS anomaly_type,
  'Total Sessions' AS metric, m.n::DOUBLE AS observed, CAST(m.n AS VARCHAR) AS observed_value,
  '<= ' || CAST(CAST(f.freq_hi AS DECIMAL(18,0)) AS VARCHAR) AS expected_range, 'Low' AS severity
FROM master m, fences f WHERE m.n > f.freq_hi
"""

LOW_FREQ = """
SELECT f.stamp AS timestamp, m.charger_id, m.station_id, 'Abnormally Low Frequency' AS anomaly_type,
  'Total Sessions' AS metric, m.n::DOUBLE AS observed, CAST(m.n AS VARCHAR) AS observed_value,
  '>= ' || CAST(CAST(f.freq_lo AS DECIMAL(18,0)) AS VARCHAR) AS expected_range, 'Low' AS severity
FROM master m, fences f WHERE m.n < f.freq_lo AND m.charger_status = 'Active'
"""

CHANGES = """
SELECT l.last, g.charger_id, c.station_id, g.r1, g.m1, CASE WHEN r1 <> 0 THEN (r2 - r1) / r1 * 100.0 END AS dr,
  CASE WHEN m1 <> 0 THEN (m2 - m1)::DOUBLE / m1 * 100.0 END AS dm
FROM (SELECT a.charger_id, a.r AS r1, b.r AS r2, a.m AS m1, b.m AS m2
  FROM (SELECT charger_id, {sum:revenue} AS r, CAST(sum(duration_minutes) AS BIGINT) AS m FROM ses, lastday
      WHERE d > last - 30 AND d <= last - 15 GROUP BY 1) a
  JOIN (SELECT charger_id, {sum:revenue} AS r, CAST(sum(duration_minutes) AS BIGINT) AS m FROM ses, lastday
      WHERE d > last - 15 GROUP BY 1) b ON a.charger_id = b.charger_id) g
JOIN chargers c ON c.charger_id = g.charger_id, lastday l
"""


def _drop(kind: str, metric: str, change: str, base: str, severity: str) -> str:
    return f"""
SELECT last::TIMESTAMP AS timestamp, charger_id, station_id, '{kind}' AS anomaly_type, '{metric}' AS metric,
  {change} AS observed, CAST(CAST({change} AS DECIMAL(18,1)) AS VARCHAR) || '%' AS observed_value,
  '>= -60.0%' AS expected_range, '{severity}' AS severity
FROM changes WHERE {base} AND {change} < -60
"""


STEPS = {
    "master": MASTER,
    "bounds": DURATION,
    "fences": FENCES,
    "lastday": "SELECT max(d) AS last FROM ses",
    "changes": CHANGES,
    "log_long": LONG,
    "log_camper": CAMPER,
    "log_failure": FAILURE,
    "log_revenue": _drop("Sudden Revenue Drop", "Revenue Change (%)", "dr", "r1 > 100", "High"),
    "log_minutes": _drop("Sudden Utilization Drop", "Utilization Change (%)", "dm", "m1 > 500", "Medium"),
    "log_high": HIGH_FREQ,
    "log_low": LOW_FREQ,
}
PARTS = [n for n in STEPS if n.startswith("log_")]
# The rule with half an interquartile range: one and a half leaves no charger below it here.
NARROW = {**STEPS, "fences": FENCES.replace("0.25)) * 1.5 AS freq_lo", "0.25)) * 0.5 AS freq_lo")}
STEPS["whole_log"] = "\nUNION ALL BY NAME\n".join(f"SELECT * FROM {n}" for n in PARTS)

SQL = {
    "charger_stats": statement(
        """
SELECT m.charger_id, m.station_id, m.charger_type, m.power_kw, m.charger_status, m.n AS total_sessions,
  m.done AS successful_sessions, m.failed AS failed_sessions, m.cut AS interrupted_sessions, m.minutes,
  m.rate AS failure_rate_pct, CASE WHEN m.n = 0 THEN 0.0 ELSE m.cut::DOUBLE / m.n * 100.0 END AS interruption_rate_pct,
  CASE WHEN m.n = 0 THEN 0.0 ELSE m.minutes::DOUBLE / m.n END AS avg_duration,
  CASE WHEN m.n = 0 THEN 0.0 ELSE m.kwh / m.n END AS avg_energy, CASE WHEN m.n = 0 THEN 0.0 ELSE m.rev / m.n END AS avg_revenue,
  m.minutes::DOUBLE / (p.days * 1440) * 100.0 AS utilization_pct
FROM master m, span24 p
""",
        **STEPS,
    ),
    "anomaly_long_session": statement("SELECT * FROM log_long", **STEPS),
    "anomaly_camper": statement("SELECT * FROM log_camper", **STEPS),
    "anomaly_high_failure": statement("SELECT * FROM log_failure", **STEPS),
    "anomaly_revenue_drop": statement("SELECT * FROM log_revenue", **STEPS),
    "anomaly_util_drop": statement("SELECT * FROM log_minutes", **STEPS),
    "anomaly_high_freq": statement("SELECT * FROM log_high", **STEPS),
    "anomaly_low_freq": statement("SELECT * FROM log_low", **NARROW),
    "anomaly_log": statement("SELECT * FROM whole_log", **STEPS),
    "anomaly_log_by_severity": statement("SELECT * FROM whole_log WHERE severity IN ('High', 'Medium')", **STEPS),
}
