"""Charger statistics and the anomaly rules with their log.

The whole log takes three passes over the fact: one rollup at two grains, by charger and by duration, gives the
volumes, the last start and the quartiles of the durations; the session rules read the sessions beyond those
quartiles; the two period rules read the two last windows only. Where the sessions come from joins, the passes
share the shuffles of those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions import calendar as cal
from voltlake.functions import measures as m
from voltlake.functions.quantiles import integer_quantiles, quantiles
from voltlake.plans.rollups import Packed, packed, sorted_once
from voltlake.sources.filters import ALL, GlobalFilter, filtered_sessions, last_start, since
from voltlake.sources.tables import Tables

# Rule names and severities of the log.
LONG_SESSION = "Unusually Long Session"
CAMPER = "Unusually Low Energy (Camper)"
HIGH_FAILURE = "High Failure Rate"
REVENUE_DROP = "Sudden Revenue Drop"
UTILIZATION_DROP = "Sudden Utilization Drop"
HIGH_FREQUENCY = "Abnormally High Frequency"
LOW_FREQUENCY = "Abnormally Low Frequency"
SEVERITIES = ("High", "Medium", "Low")

LOG = (
    "timestamp", "charger_id", "station_id", "anomaly_type", "metric", "observed",
    "observed_value", "expected_range", "severity",
)


_VOLUME = (
    "total_sessions", "successful_sessions", "failed_sessions", "interrupted_sessions",
    "minutes", "timed", "energy_u", "metered", "revenue_u", "billed",
)
_EXACT = ("energy_u", "revenue_u")
_BY_CHARGER, _BY_DURATION = 0, 1


def _grains(sessions: DataFrame) -> Packed:
    """Volume per charger and rows per duration, with the first and last start, from one pass."""
    return packed(sessions, ["station_id", "charger_id", "duration_minutes"], {
        "rows": F.count(F.lit(1)),
        "total_sessions": F.count("session_id"),
        "successful_sessions": m.count_status("Completed"),
        "failed_sessions": m.count_status("Failed"),
        "interrupted_sessions": m.count_status("Cancelled"),
        "minutes": m.sum_long("duration_minutes"),
        "timed": F.count("duration_minutes"),
        **m.parts("energy_u", "energy_kwh"),
        "metered": F.count("energy_kwh"),
        **m.parts("revenue_u", "revenue"),
        "billed": F.count("revenue"),
        "first": F.min(cal.micros("start_time")),
        "last": F.max(cal.micros("start_time")),
    }, ["station_id", "charger_id"], ["duration_minutes"])


def _last_start(grains: Packed) -> Column:
    return grains.frame.agg(cal.from_micros(grains.max("last")).alias("last_start")).scalar()


def _elapsed_days(grains: Packed) -> Column:
    bounds = grains.frame.agg(
        cal.from_micros(grains.min("first")).alias("lo"), cal.from_micros(grains.max("last")).alias("hi")
    )
    return bounds.select(cal.whole_days("lo", "hi").alias("days")).scalar()


def _charger_master(t: Tables, grains: Packed) -> DataFrame:
    """Every charger with its volume, 0 without sessions."""
    volume = grains.frame.filter(
        (F.col("grain") == _BY_CHARGER) & F.col("station_id").isNotNull() & F.col("charger_id").isNotNull()
    ).select("station_id", "charger_id", *[
        (grains.exact(name) if name in _EXACT else grains.measure(name)).alias(name) for name in _VOLUME
    ])
    joined = t.chargers.join(volume, ["station_id", "charger_id"], "left")
    return joined.na.fill(0, subset=list(_VOLUME)).withColumn(
        "failure_rate_pct", m.rate("failed_sessions", "total_sessions") * 100.0
    )


def charger_stats(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """Volume, outcome rates, averages and utilization of every charger."""
    grains = _grains(filtered_sessions(t, flt))
    return _charger_master(t, grains).select(
        "charger_id", "station_id", "charger_type", "power_kw", "charger_status",
        "total_sessions", "successful_sessions", "failed_sessions", "interrupted_sessions", "minutes",
        "failure_rate_pct",
        (m.rate("interrupted_sessions", "total_sessions") * 100.0).alias("interruption_rate_pct"),
        m.rate("minutes", "timed").alias("avg_duration"),
        m.rate(m.from_units("energy_u"), "metered").alias("avg_energy"),
        m.rate(m.from_units("revenue_u"), "billed").alias("avg_revenue"),
        m.charger_utilization("minutes", _elapsed_days(grains)).alias("utilization_pct"),
    )


def _text(value: Column, digits: int) -> Column:
    """A number with a fixed count of decimals, half up."""
    return value.cast(f"decimal(28,{digits})").cast("string")


def _entry(
    when: Column, timestamp: Column, anomaly_type: str, metric: str, observed: Column,
    observed_value: Column, expected_range: Column, severity: str,
) -> Column:
    """One log entry where ``when`` holds, else NULL."""
    return F.when(when, F.struct(
        timestamp.cast("timestamp_ntz").alias("timestamp"),
        F.lit(anomaly_type).alias("anomaly_type"),
        F.lit(metric).alias("metric"),
        observed.cast("double").alias("observed"),
        observed_value.alias("observed_value"),
        expected_range.alias("expected_range"),
        F.lit(severity).alias("severity"),
    ))


def _log(df: DataFrame, entries: Sequence[Column]) -> DataFrame:
    """One log row for each entry of a row that is not NULL."""
    rows = df.select("charger_id", "station_id", F.explode(F.array(*entries)).alias("e"))
    return rows.filter(F.col("e").isNotNull()).select("charger_id", "station_id", "e.*").select(*LOG)


def _session_rules(
    sessions: DataFrame, grains: Packed, rules: Sequence[str], max_kwh: float = 2, k: float = 3
) -> DataFrame:
    """Long sessions and campers; a long session is never also a camper."""
    durations = grains.frame.filter(F.col("grain") == _BY_DURATION)
    quartiles = integer_quantiles(durations, "duration_minutes", [0.25, 0.75], grains.measure("rows"))
    minutes, upper, q3 = F.col("duration_minutes"), F.col("upper"), F.col("q3")
    rows = sessions.select("charger_id", "station_id", "start_time", "duration_minutes", "energy_kwh", quartiles.alias("q"))
    rows = rows.withColumns({
        "q3": F.col("q")[1], "upper": F.col("q")[1] + (F.col("q")[1] - F.col("q")[0]) * float(k),
    })
    long = minutes > upper
    camper = (minutes > q3) & (F.col("energy_kwh") < float(max_kwh))
    hit = {LONG_SESSION: long, CAMPER: ~long & camper}
    found = rows.filter(hit[rules[0]] if len(rules) == 1 else long | camper)

    def either(if_long, if_camper) -> Column:
        return F.when(long, if_long).otherwise(if_camper)

    return found.select(
        F.col("start_time").alias("timestamp"),
        "charger_id",
        "station_id",
        either(LONG_SESSION, CAMPER).alias("anomaly_type"),
        either("Duration (min)", "Energy (kWh)").alias("metric"),
        either(minutes.cast("double"), F.col("energy_kwh")).alias("observed"),
        either(_text(minutes, 1), _text(F.col("energy_kwh"), 2)).alias("observed_value"),
        either(F.concat(F.lit("<= "), _text(upper, 1)), F.lit(f"> {float(max_kwh):.1f}")).alias("expected_range"),
        either("Medium", "High").alias("severity"),
    )


def _charger_rules(
    t: Tables, grains: Packed, rules: Sequence[str],
    fail_k: float = 1.5, floor_lt: float = 1, floor_to: float = 2, min_sessions: int = 15, freq_k: float = 1.5,
) -> DataFrame:
    """Failure-rate and session-count outliers over all chargers, unused ones included."""
    master = _charger_master(t, grains).select(
        "charger_id", "station_id", "charger_status", "failed_sessions", "total_sessions", "failure_rate_pct"
    )
    wanted = {}
    if HIGH_FAILURE in rules:
        wanted["failure_rate_pct"] = [0.25, 0.75]
    if HIGH_FREQUENCY in rules or LOW_FREQUENCY in rules:
        wanted["total_sessions"] = [0.25, 0.75]
    rows = master.withColumns({"q": quantiles(master, wanted), "stamp": _last_start(grains)})
    stamp = F.col("stamp")
    entries = {}
    if HIGH_FAILURE in rules:
        q1, q3 = F.col("q.failure_rate_pct")[0], F.col("q.failure_rate_pct")[1]
        fence = q3 + (q3 - q1) * float(fail_k)
        bound = F.when(fence < floor_lt, F.lit(float(floor_to))).otherwise(fence)
        rate = F.col("failure_rate_pct")
        entries[HIGH_FAILURE] = _entry(
            (rate > bound) & (F.col("total_sessions") > min_sessions), stamp, HIGH_FAILURE, "Failure Rate (%)",
            rate, F.concat(_text(rate, 1), F.lit("%")), F.concat(F.lit("<= "), _text(bound, 1), F.lit("%")), "High",
        )
    if "total_sessions" in wanted:
        q1, q3 = F.col("q.total_sessions")[0], F.col("q.total_sessions")[1]
        spread = (q3 - q1) * float(freq_k)
        upper, lower = q3 + spread, F.greatest(F.lit(1.0), q1 - spread)
        n = F.col("total_sessions")
        entries[HIGH_FREQUENCY] = _entry(
            n > upper, stamp, HIGH_FREQUENCY, "Total Sessions", n, n.cast("string"),
            F.concat(F.lit("<= "), _text(upper, 0)), "Low",
        )
        entries[LOW_FREQUENCY] = _entry(
            ~(n > upper) & (n < lower) & (F.col("charger_status") == "Active"), stamp, LOW_FREQUENCY,
            "Total Sessions", n, n.cast("string"), F.concat(F.lit(">= "), _text(lower, 0)), "Low",
        )
    return _log(rows, [entries[r] for r in rules])


def _drop_rules(
    t: Tables, sessions: DataFrame, last_start: Column, rules: Sequence[str],
    days: int = 15, revenue_base: float = 100, minutes_base: int = 500, pct: float = -60, shared: bool = False,
) -> DataFrame:
    """Chargers present in both windows whose revenue or minutes fell by more than ``pct``.

    The last ``days`` dates against the ``days`` before, by conditional
    aggregation in one scan of both windows (the bound reaches the scan; ``shared`` as in :func:`since`).
    """
    last = F.to_date(last_start)
    first_midnight = F.date_sub(last, 2 * days - 1).cast("timestamp_ntz")
    late = F.col("late")
    both = since(sessions, first_midnight, inclusive=True, shared=shared).filter(F.col("charger_id").isNotNull())
    both = both.withColumn("late", cal.day() > F.date_sub(last, days))
    change = both.groupBy("charger_id").agg(
        F.count_if(~late).alias("n1"),
        F.count_if(late).alias("n2"),
        m.exact_sum("revenue", ~late).alias("revenue1"),
        m.exact_sum("revenue", late).alias("revenue2"),
        m.sum_long("duration_minutes", ~late).alias("minutes1"),
        m.sum_long("duration_minutes", late).alias("minutes2"),
    ).filter((F.col("n1") > 0) & (F.col("n2") > 0))
    change = change.select(
        "charger_id", "revenue1", "minutes1",
        (m.sql_rate(F.col("revenue2") - F.col("revenue1"), "revenue1") * 100.0).alias("revenue_change"),
        (m.sql_rate(F.col("minutes2") - F.col("minutes1"), "minutes1") * 100.0).alias("minutes_change"),
    )
    located = change.join(t.chargers.select("charger_id", "station_id"), "charger_id").withColumn("last", last)
    expected = F.concat(F.lit(">= "), _text(F.lit(float(pct)), 1), F.lit("%"))

    def entry(rule: str, metric: str, base: Column, value: str, severity: str) -> Column:
        return _entry(
            base & (F.col(value) < float(pct)), F.col("last"), rule, metric, F.col(value),
            F.concat(_text(F.col(value), 1), F.lit("%")), expected, severity,
        )

    entries = {
        REVENUE_DROP: entry(
            REVENUE_DROP, "Revenue Change (%)", F.col("revenue1") > float(revenue_base), "revenue_change", "High"
        ),
        UTILIZATION_DROP: entry(
            UTILIZATION_DROP, "Utilization Change (%)", F.col("minutes1") > minutes_base, "minutes_change", "Medium"
        ),
    }
    return _log(located, [entries[r] for r in rules])


def anomaly_long_session(t: Tables, k: float = 3, flt: GlobalFilter = ALL) -> DataFrame:
    """Sessions longer than Q3 + k x IQR of all durations."""
    s = filtered_sessions(t, flt)
    return _session_rules(s, _grains(s), [LONG_SESSION], k=k)


def anomaly_camper(t: Tables, max_kwh: float = 2, k: float = 3, flt: GlobalFilter = ALL) -> DataFrame:
    """Sessions above Q3 of all durations that drew less than ``max_kwh`` and are not long sessions."""
    s = filtered_sessions(t, flt)
    return _session_rules(s, _grains(s), [CAMPER], max_kwh, k)


def anomaly_high_failure(
    t: Tables, k: float = 1.5, floor_lt: float = 1, floor_to: float = 2, min_sessions: int = 15,
    flt: GlobalFilter = ALL,
) -> DataFrame:
    """Chargers failing above Q3 + k x IQR; a bound below ``floor_lt`` becomes ``floor_to``."""
    grains = _grains(filtered_sessions(t, flt))
    return _charger_rules(t, grains, [HIGH_FAILURE], k, floor_lt, floor_to, min_sessions)


def anomaly_revenue_drop(
    t: Tables, days: int = 15, min_base: float = 100, pct: float = -60, flt: GlobalFilter = ALL
) -> DataFrame:
    s = filtered_sessions(t, flt)
    return _drop_rules(t, s, last_start(t, s, flt), [REVENUE_DROP], days, revenue_base=min_base, pct=pct)


def anomaly_util_drop(
    t: Tables, days: int = 15, min_base: int = 500, pct: float = -60, flt: GlobalFilter = ALL
) -> DataFrame:
    s = filtered_sessions(t, flt)
    return _drop_rules(t, s, last_start(t, s, flt), [UTILIZATION_DROP], days, minutes_base=min_base, pct=pct)


def anomaly_high_freq(t: Tables, k: float = 1.5, flt: GlobalFilter = ALL) -> DataFrame:
    """Chargers with more sessions than Q3 + k x IQR."""
    return _charger_rules(t, _grains(filtered_sessions(t, flt)), [HIGH_FREQUENCY], freq_k=k)


def anomaly_low_freq(t: Tables, k: float = 1.5, flt: GlobalFilter = ALL) -> DataFrame:
    """Active chargers with fewer sessions than max(1, Q1 - k x IQR)."""
    return _charger_rules(t, _grains(filtered_sessions(t, flt)), [LOW_FREQUENCY], freq_k=k)


def _by_severity(log: DataFrame) -> DataFrame:
    """High, Medium, Low; the other columns make the order total and the sort's ranges even."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return sorted_once(log, rank, "anomaly_type", "timestamp", "station_id", "charger_id", "observed")


def anomaly_log(t: Tables, flt: GlobalFilter = ALL) -> DataFrame:
    """All anomaly rules as one log, most severe first; every entry is kept."""
    return _by_severity(_all_rules(t, flt))


def _all_rules(t: Tables, flt: GlobalFilter) -> DataFrame:
    s = filtered_sessions(t, flt)
    grains = _grains(s)
    return _session_rules(s, grains, [LONG_SESSION, CAMPER]).unionByName(
        _charger_rules(t, grains, [HIGH_FAILURE, HIGH_FREQUENCY, LOW_FREQUENCY])
    ).unionByName(_drop_rules(t, s, _last_start(grains), [REVENUE_DROP, UTILIZATION_DROP], shared=True))


def anomaly_log_by_severity(
    t: Tables, severities: Sequence[str] = SEVERITIES, flt: GlobalFilter = ALL
) -> DataFrame:
    """The log restricted to some severities; none selected gives no rows."""
    return _by_severity(_all_rules(t, flt).filter(F.col("severity").isin(list(severities))))
