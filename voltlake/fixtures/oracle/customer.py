"""Customers and vehicles."""

from voltlake.fixtures.oracle.base import statement

CUST = """
SELECT customer_id, count(session_id) AS total_sessions, {sum:energy_kwh} AS total_energy_kwh,
  {sum:revenue} AS total_revenue, avg(duration_minutes) AS avg_duration
FROM sessions GROUP BY customer_id
"""
CUTS = """
SELECT quantile_cont(total_revenue, 0.75) AS r, quantile_cont(total_sessions, 0.75) AS s,
  quantile_cont(total_energy_kwh, 0.75) AS e FROM cust
"""
SEGMENTED = """
SELECT customer_id, total_sessions, total_energy_kwh, total_revenue,
  CASE WHEN total_revenue >= r THEN 'High Revenue' WHEN total_sessions >= s THEN 'High Frequency'
       WHEN total_energy_kwh >= e THEN 'High Energy' ELSE 'Occasional' END AS segment
FROM cust, cuts
"""
STEPS = {"cust": CUST, "cuts": CUTS, "segmented": SEGMENTED}

SQL = {
    "customer_kpis": statement(
        """
SELECT count(*) AS customers, sum(total_sessions)::DOUBLE / count(*) AS avg_sessions_per_customer,
  {sum:total_energy_kwh} / count(*) AS avg_energy_per_customer, {sum:total_revenue} / count(*) AS avg_revenue_per_customer,
  round(avg(avg_duration), 6) AS avg_session_duration, count(*) FILTER (total_sessions > 1) AS repeat_customers,
  count(*) FILTER (total_sessions > 1)::DOUBLE / count(*) * 100.0 AS repeat_rate_pct,
  sum(total_sessions)::DOUBLE / count(*) / (max(span.days) / 30.0::DOUBLE) AS sessions_per_30_days
FROM cust, span
""",
        **STEPS,
    ),
    "customer_segments": statement("SELECT * FROM segmented", **STEPS),
    "segment_summary": statement(
        """
SELECT segment, count(*) AS customers, {sum:total_revenue} AS total_revenue, {sum:total_energy_kwh} AS total_energy_kwh,
  sum(total_sessions)::DOUBLE / count(*) AS avg_sessions,
  count(*)::DOUBLE / (SELECT count(*) FROM cust) * 100.0 AS pct_of_customers,
  {sum:total_revenue} / (SELECT {sum:total_revenue} FROM cust) * 100.0 AS pct_of_revenue
FROM segmented GROUP BY segment
""",
        **STEPS,
    ),
    "vehicle_intelligence": statement("""
SELECT vehicle_type, count(session_id) AS sessions, {sum:energy_kwh} AS energy_kwh, {sum:revenue} AS revenue,
  CAST(sum(duration_minutes) AS BIGINT) AS minutes, {sum:energy_kwh} / count(session_id) AS avg_kwh_per_session,
  sum(duration_minutes)::DOUBLE / count(session_id) AS avg_duration, {sum:revenue} / count(session_id) AS avg_revenue
FROM sessions GROUP BY vehicle_type
"""),
}
