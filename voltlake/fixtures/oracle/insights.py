"""Findings."""

from voltlake.fixtures.oracle.base import statement

# 'finite' leaves stations without active chargers out, 'open' makes them infinite.
STN = """
SELECT g.station_id, t.station_name, g.n, g.rev, coalesce(a.n, 0) AS active, g.failed::DOUBLE / g.n * 100.0 AS failure,
  CASE WHEN coalesce(a.n, 0) > 0 THEN g.mins::DOUBLE / (a.n * span.days * 1440) * 100.0 END AS util,
  coalesce(a.n, 0) = 0 AND g.mins > 0 AS boundless
FROM (SELECT station_id, count(session_id) AS n, sum(CAST(revenue AS DECIMAL(18,4))) AS rev,
    CAST(sum(duration_minutes) AS BIGINT) AS mins, count(*) FILTER (session_status = 'Failed') AS failed
  FROM ses GROUP BY station_id) g CROSS JOIN span
LEFT JOIN act a ON a.station_id = g.station_id LEFT JOIN stations t ON t.station_id = g.station_id
"""


def _one(x: str) -> str:
    return f"CASE WHEN {x} = 'Infinity'::DOUBLE THEN 'infinite' ELSE CAST(CAST({x} AS DECIMAL(18,1)) AS VARCHAR) END"


def _finding(no: int, name: str, subject: str, value: str, baseline: str, support: str, sentence: str, source: str) -> str:
    return f"""
SELECT CAST({no} AS BIGINT) AS insight_id, '{name}' AS insight, CAST({subject} AS VARCHAR) AS subject,
  round(CAST({value} AS DOUBLE), 6) AS value, round(CAST({baseline} AS DOUBLE), 6) AS baseline,
  CAST({support} AS BIGINT) AS support, {sentence} AS sentence
FROM {source}
"""


FINITE_MEAN = "(SELECT avg(util) AS mu FROM stn)"
OPEN_MEAN = "(SELECT CASE WHEN bool_or(boundless) THEN 'Infinity'::DOUBLE ELSE avg(util) END AS mu FROM stn)"
TOP = "(SELECT * FROM stn WHERE util IS NOT NULL ORDER BY util DESC, station_id LIMIT 1)"
LOW = "(SELECT * FROM stn WHERE active > 0 ORDER BY util, station_id LIMIT 1)"
WORST = "(SELECT * FROM stn ORDER BY failure DESC, rev DESC, station_id LIMIT 1)"
SHARE = """
SELECT k, CAST(top AS DOUBLE) AS top, top::DOUBLE / total::DOUBLE * 100.0 AS share
FROM (SELECT max(k) AS k, sum(rev) FILTER (r <= k) AS top, sum(rev) AS total
  FROM (SELECT rev, row_number() OVER (ORDER BY rev DESC) AS r, greatest(1, CAST(floor(count(*) OVER () * 0.1::DOUBLE) AS BIGINT)) AS k FROM stn))
"""
PEAK = """
SELECT h, n, n / (SELECT avg(n) FROM (SELECT count(*) AS n FROM ses GROUP BY h)) AS ratio
FROM (SELECT h, count(*) AS n FROM ses GROUP BY h) ORDER BY n DESC, h LIMIT 1
"""
CAMPERS = "SELECT count(*) AS n FROM sessions WHERE duration_minutes > 240 AND energy_kwh < 2"


def _pressure(ratio: float) -> str:
    return _finding(
        1, "Capacity pressure", "station_name", "util", "mu", "1",
        f"station_name || ' runs at ' || {_one('util')} || '% utilization; the network mean is ' || {_one('mu')} || '%.'",
        f"{TOP} x, {FINITE_MEAN} y WHERE util > mu * {ratio}",
    )


def _failure(pct: float, ratio: float) -> str:
    return _finding(
        3, "Failure rate", "station_name", "failure", "mf", "n",
        f"station_name || ' fails in ' || {_one('failure')} || '% of ' || CAST(n AS VARCHAR)"
        f" || ' sessions; the network mean is ' || {_one('mf')} || '%.'",
        f"{WORST} x, (SELECT avg(failure) AS mf FROM stn) y WHERE failure > {pct} AND failure > mf * {ratio}",
    )


def _under(util: float) -> str:
    return _finding(
        4, "Underutilization", "station_name", "util", "mu", "1",
        f"station_name || ' is used at only ' || {_one('util')} || '%; the network mean is ' || {_one('mu')} || '%.'",
        f"{LOW} x, {OPEN_MEAN} y WHERE util < {util} AND mu > 5",
    )


def _revenue(pct: float) -> str:
    return _finding(
        2, "Revenue concentration", "NULL", "share", "10.0", "k",
        "'The top ' || CAST(k AS VARCHAR) || ' stations earn ' || " + _one("share")
        + " || '% of all revenue (' || CAST(CAST(top AS DECIMAL(18,0)) AS VARCHAR) || ').'",
        f"share WHERE share > {pct}",
    )


HOUR = _finding(
    5, "Peak hour", "h", "ratio", "1.3", "n",
    "'Demand peaks at ' || CAST(h AS VARCHAR) || ':00 with ' || " + _one("ratio") + " || ' times the mean hourly sessions.'",
    "peak WHERE ratio > 1.3",
)
CAMP = _finding(
    6, "Campers", "NULL", "n", "50", "n",
    "CAST(n AS VARCHAR) || ' sessions held a charger for more than 240 minutes and drew less than 2.0 kWh.'",
    "campers WHERE n > 50",
)
STEPS = {"stn": STN, "share": SHARE, "peak": PEAK, "campers": CAMPERS}

SQL = {
    "insight_capacity_pressure": statement(_pressure(1.5), **STEPS),
    "insight_revenue_concentration": statement(_revenue(10), **STEPS),
    "insight_failure": statement(_failure(3, 1.2), **STEPS),
    "insight_underutilized": statement(_under(2), **STEPS),
    "insight_peak_hour": statement(HOUR, **STEPS),
    "insight_campers": statement(CAMP, **STEPS),
    "insights": statement(
        "\nUNION ALL\n".join(
            f"SELECT * FROM ({part})"
            # With an infinite mean the first rule cannot fire.
            for part in (
                _pressure(1.5).rstrip() + " AND NOT (SELECT bool_or(boundless) FROM stn)",
                _revenue(15), _failure(3, 2), _under(2), HOUR, CAMP,
            )
        ),
        **STEPS,
    ),
}
