"""Exact distinct counts of trailing months; the estimates must lie within their bound."""

from voltlake.fixtures.oracle.base import statement

SQL = {
    "trailing_distinct_check": statement(
        """
SELECT n.month, count(*) AS sessions, count(DISTINCT customer_id) AS exact_customers,
  count(DISTINCT station_id) AS exact_stations, count(DISTINCT charger_id) AS exact_chargers,
  TRUE AS customers_within, TRUE AS stations_within, TRUE AS chargers_within
FROM (SELECT DISTINCT month FROM dated) n JOIN dated s ON s.month <= n.month AND s.month > n.month - INTERVAL 3 MONTH
GROUP BY n.month
""",
        dated="SELECT *, CAST(date_trunc('month', start_time) AS DATE) AS month FROM sessions",
    ),
}
