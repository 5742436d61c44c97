"""Integrity rules on the faulty copies."""

from voltlake.fixtures.oracle.base import statement
from voltlake.operators.quality import RULES

FLAGGED = """
SELECT s.*,
  (s.session_id IS NULL OR s.station_id IS NULL OR s.charger_id IS NULL OR s.customer_id IS NULL OR s.vehicle_type IS NULL
   OR s.start_time IS NULL OR s.end_time IS NULL OR s.duration_minutes IS NULL OR s.energy_kwh IS NULL
   OR s.price_per_kwh IS NULL OR s.revenue IS NULL OR s.session_status IS NULL OR s.payment_status IS NULL) AS missing,
  count(*) OVER (PARTITION BY s.session_id) > 1 AS duplicate,
  coalesce(s.start_time >= s.end_time, false) AS timestamps,
  coalesce(s.energy_kwh < 0, false) AS negative_energy, coalesce(s.revenue < 0, false) AS negative_revenue,
  coalesce(s.duration_minutes <= 0, false) AS durations,
  NOT EXISTS (SELECT 1 FROM stations t WHERE t.station_id = s.station_id) AS station_fk,
  NOT EXISTS (SELECT 1 FROM chargers_raw c WHERE c.charger_id = s.charger_id) AS charger_fk,
  EXISTS (SELECT 1 FROM chargers_raw c WHERE c.charger_id = s.charger_id AND c.station_id IS NOT NULL
    AND c.station_id IS DISTINCT FROM s.station_id) AS inconsistent
FROM sessions_raw s
"""
SESSION_FLAGS = [r for r in RULES if r != "orphan"]
INVALID = " OR ".join(SESSION_FLAGS)
ORPHANS = "SELECT count(*) AS n FROM chargers_raw c WHERE NOT EXISTS (SELECT 1 FROM stations t WHERE t.station_id = c.station_id)"


def _count(rule: str) -> str:
    return "SELECT n FROM orphans" if rule == "orphan" else f"SELECT count(*) FILTER ({rule}) AS n FROM flagged"


VIOLATIONS = "\nUNION ALL\n".join(
    f"SELECT CAST({i} AS BIGINT) AS rule_no, '{title}' AS rule, ({_count(rule)}) AS violations, '{text}' AS description"
    for i, (rule, (title, text)) in enumerate(RULES.items(), start=1)
)
STEPS = {"flagged": FLAGGED, "orphans": ORPHANS, "broken": VIOLATIONS}

KEYS = {
    "dq_missing": "missing", "dq_duplicates": "duplicate", "dq_timestamps": "timestamps",
    "dq_negative_energy": "negative_energy", "dq_negative_revenue": "negative_revenue",
    "dq_durations": "durations", "dq_station_fk": "station_fk", "dq_charger_fk": "charger_fk",
    "dq_orphan_chargers": "orphan", "dq_inconsistent": "inconsistent",
}

SQL = {
    **{
        key: statement(f"SELECT '{RULES[rule][0]}' AS rule, ({_count(rule)}) AS violations", **STEPS)
        for key, rule in KEYS.items()
    },
    "dq_report": statement("SELECT * FROM broken WHERE violations > 0", **STEPS),
    "dq_summary": statement(
        f"""
SELECT count(*) AS total_records, count(*) FILTER (NOT ({INVALID})) AS valid_records,
  count(*) FILTER ({INVALID}) AS invalid_records,
  count(*) FILTER (NOT ({INVALID}))::DOUBLE / count(*) * 100.0 AS valid_pct,
  (SELECT count(*) FROM broken WHERE violations > 0) AS warnings
FROM flagged
""",
        **STEPS,
    ),
    "dq_flags": statement(
        f"SELECT session_id, station_id, charger_id, start_time, {', '.join(SESSION_FLAGS)}, ({INVALID}) AS is_invalid FROM flagged",
        **STEPS,
    ),
}

RAW_FAULT = """
SELECT *, CASE WHEN session_id % 257 = 0 THEN 'number' WHEN session_id % 263 = 0 THEN 'short'
  WHEN session_id % 269 = 0 THEN 'timestamp' WHEN session_id % 271 = 0 THEN 'early' END AS fault FROM sessions
"""
SQL |= {
    "raw_scan": statement("""
SELECT 'stations' AS table_name, count(*) AS rows, 0::BIGINT AS unreadable, 0::BIGINT AS bad_timestamps, 0::BIGINT AS late_sessions FROM stations
UNION ALL SELECT 'chargers', count(*), 0, 0, 0 FROM chargers
UNION ALL SELECT 'charging_sessions', count(*), count(*) FILTER (fault IN ('number', 'short')), count(*) FILTER (fault = 'timestamp'),
  count(*) FILTER (fault = 'early') FROM raw_fault
""", raw_fault=RAW_FAULT),
    "unreadable_records": statement("""
SELECT 'charging_sessions' AS table_name, CAST(session_id AS VARCHAR) AS session_id, CASE WHEN fault = 'short' THEN 5 ELSE 13 END::INTEGER AS fields
FROM raw_fault WHERE fault IN ('number', 'short')
""", raw_fault=RAW_FAULT),
}
