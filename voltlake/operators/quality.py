"""Ten integrity rules over the raw tables. Rows are flagged, never dropped.

Rules 1 to 8 and 10 look at sessions, rule 9 at chargers. The key rules depend on the
station and the charger of a session alone, so they are checked once per pair, against the dimension
tables; rows are joined once, to the list of violating pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlake.functions import measures as m
from voltlake.sources.tables import BROKEN, SESSION_COLUMNS, Tables

# Rule names, in rule order; descriptions are ours.
RULES = {
    "missing": ("Missing Values", "a session column is empty"),
    "duplicate": ("Duplicate Sessions", "several rows share one session_id"),
    "timestamps": ("Invalid Timestamps", "start_time is not before end_time"),
    "negative_energy": ("Negative Energy", "energy_kwh is below 0"),
    "negative_revenue": ("Negative Revenue", "revenue is below 0"),
    "durations": ("Impossible Durations", "duration_minutes is 0 or below"),
    "station_fk": ("Invalid Station IDs", "the station of a session is not in stations"),
    "charger_fk": ("Invalid Charger IDs", "the charger of a session is not in chargers"),
    "orphan": ("Orphan Chargers", "the station of a charger is not in stations"),
    "inconsistent": (
        "Inconsistent Architecture (Relational Mismatch)",
        "the charger of a session belongs to another station",
    ),
}
SESSION_RULES = tuple(r for r in RULES if r != "orphan")
KEY_RULES = ("station_fk", "charger_fk", "inconsistent")
LOCAL_RULES = ("missing", "timestamps", "negative_energy", "negative_revenue", "durations")


def _moment(sessions: DataFrame, column: str) -> Column:
    """A timestamp column; text that does not parse becomes NULL."""
    if isinstance(sessions.schema[column].dataType, T.StringType):
        return F.col(column).try_cast("timestamp_ntz")
    return F.col(column)


def _local_flags(sessions: DataFrame) -> dict[str, Column]:
    """Flags that depend on the row alone; a NULL never violates rules 3 to 6."""
    missing = F.lit(False)
    for c in SESSION_COLUMNS:
        missing = missing | F.col(c).isNull()
    late = _moment(sessions, "start_time") >= _moment(sessions, "end_time")
    flags = {
        "missing": missing,
        "timestamps": late,
        "negative_energy": F.col("energy_kwh") < 0,
        "negative_revenue": F.col("revenue") < 0,
        "durations": F.col("duration_minutes") <= 0,
    }
    return {name: F.coalesce(flag, F.lit(False)) for name, flag in flags.items()}


def _bits(flags: dict[str, Column], rules: tuple[str, ...]) -> Column:
    """The flags of some rules as one BIGINT, a bit for each rule."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(flags[rule], F.lit(1 << SESSION_RULES.index(rule)).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def _known_stations(t: Tables) -> DataFrame:
    return t.stations.select("station_id").distinct().withColumn("known_station", F.lit(True))


def _known_chargers(t: Tables) -> DataFrame:
    return t.chargers.groupBy("charger_id").agg(F.max("station_id").alias("expected_station")).withColumn(
        "known_charger", F.lit(True)
    )


def _key_flags(t: Tables, rows: DataFrame) -> DataFrame:
    """Add the key rules. A NULL station is unknown, and differs from any expected one."""
    joined = rows.join(_known_stations(t), "station_id", "left").join(_known_chargers(t), "charger_id", "left")
    flags = {
        "station_fk": F.col("known_station").isNull(),
        "charger_fk": F.col("known_charger").isNull(),
        "inconsistent": F.col("expected_station").isNotNull()
        & ~F.col("station_id").eqNullSafe(F.col("expected_station")),
    }
    return joined.withColumns(flags).drop("known_station", "known_charger", "expected_station")


def _with_key_flags(t: Tables, rows: DataFrame) -> DataFrame:
    """``rows`` of the sessions with the key rules, by one null-safe join to the pairs that violate any.

    The list has a row for each such pair at most, so a hot pair, or NULL, is split by AQE's skew join. The list is
    hashed in each task, a part of the pairs, and the rows stream past it: they are not sorted.
    """
    any_rule = F.lit(False)
    for rule in KEY_RULES:
        any_rule = any_rule | F.col(rule)
    bad = _key_flags(t, _pairs(t)).filter(any_rule).select(
        F.col("station_id").alias("bad_station"), F.col("charger_id").alias("bad_charger"), *KEY_RULES
    )
    same = F.col("station_id").eqNullSafe(F.col("bad_station")) & F.col("charger_id").eqNullSafe(F.col("bad_charger"))
    joined = rows.join(bad.hint("shuffle_hash"), same, "left").drop("bad_station", "bad_charger")
    return joined.withColumns({rule: F.coalesce(rule, F.lit(False)) for rule in KEY_RULES})


def _one_rule(rule: str, counted: DataFrame) -> DataFrame:
    return counted.select(F.lit(RULES[rule][0]).alias("rule"), F.col("violations").cast("long").alias("violations"))


def _count_local(t: Tables, rule: str) -> DataFrame:
    flag = _local_flags(t.sessions)[rule]
    return _one_rule(rule, t.sessions.agg(F.count_if(flag).alias("violations")))


def _pairs(t: Tables) -> DataFrame:
    """Session rows per (station, charger): the key rules need nothing else."""
    return t.sessions.groupBy("station_id", "charger_id").agg(F.count(F.lit(1)).alias("rows"))


def _count_key(t: Tables, rule: str) -> DataFrame:
    hits = _key_flags(t, _pairs(t)).agg(
        F.coalesce(F.sum(F.when(F.col(rule), F.col("rows"))), F.lit(0)).alias("violations")
    )
    return _one_rule(rule, hits)


def _duplicate_rows(t: Tables) -> DataFrame:
    """All copies count. A NULL id shared by several rows is a duplicate, too."""
    per_id = t.sessions.groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"))
    return per_id.agg(
        F.coalesce(F.sum(F.when(F.col("rows") > 1, F.col("rows"))), F.lit(0)).alias("violations")
    )


def _orphan_chargers(t: Tables) -> DataFrame:
    return (
        t.chargers.join(t.stations.select("station_id"), "station_id", "left_anti")
        .agg(F.count(F.lit(1)).alias("violations"))
    )


def dq_missing(t: Tables) -> DataFrame:
    return _count_local(t, "missing")


def dq_duplicates(t: Tables) -> DataFrame:
    return _one_rule("duplicate", _duplicate_rows(t))


def dq_timestamps(t: Tables) -> DataFrame:
    return _count_local(t, "timestamps")


def dq_negative_energy(t: Tables) -> DataFrame:
    return _count_local(t, "negative_energy")


def dq_negative_revenue(t: Tables) -> DataFrame:
    return _count_local(t, "negative_revenue")


def dq_durations(t: Tables) -> DataFrame:
    return _count_local(t, "durations")


def dq_station_fk(t: Tables) -> DataFrame:
    return _count_key(t, "station_fk")


def dq_charger_fk(t: Tables) -> DataFrame:
    return _count_key(t, "charger_fk")


def dq_orphan_chargers(t: Tables) -> DataFrame:
    return _one_rule("orphan", _orphan_chargers(t))


def dq_inconsistent(t: Tables) -> DataFrame:
    return _count_key(t, "inconsistent")


def _all_violations(t: Tables) -> DataFrame:
    """Rows violating each rule: one scan grouped by (station, charger), one grouped by id."""
    flags = _local_flags(t.sessions)
    pairs = t.sessions.groupBy("station_id", "charger_id").agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(flag).alias(name) for name, flag in flags.items()]
    )
    counted = _key_flags(t, pairs).agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in LOCAL_RULES],
        *[F.coalesce(F.sum(F.when(F.col(name), F.col("rows"))), F.lit(0)).alias(name) for name in KEY_RULES],
    )
    return counted.withColumns({
        "duplicate": _duplicate_rows(t).scalar(),
        "orphan": _orphan_chargers(t).scalar(),
    })


def dq_report(t: Tables) -> DataFrame:
    """One row per violated rule, in rule order."""
    rows = F.array(*[
        F.struct(
            F.lit(i).cast("long").alias("rule_no"),
            F.lit(title).alias("rule"),
            F.col(name).cast("long").alias("violations"),
            F.lit(text).alias("description"),
        )
        for i, (name, (title, text)) in enumerate(RULES.items(), start=1)
    ])
    report = _all_violations(t).select(F.explode(rows).alias("r")).select("r.*")
    return report.filter(F.col("violations") > 0).orderBy("rule_no")


def dq_summary(t: Tables) -> DataFrame:
    """Rows in total, valid and invalid (violating any session rule), and rules violated.

    Per session_id the rows, the rows violating another rule and the rules violated by any are found: of an id with
    several rows all are invalid. Flags are not joined back, and a hot id is combined before the shuffle. The flags
    of a row, and of an id, are the bits of one number, so that an id takes three numbers of a task's memory.
    """
    local = _bits(_local_flags(t.sessions), LOCAL_RULES)
    flagged = _with_key_flags(t, t.sessions.select("session_id", "station_id", "charger_id", local.alias("local")))
    rules = F.col("local").bitwiseOR(_bits({r: F.col(r) for r in KEY_RULES}, KEY_RULES))
    per_id = flagged.select("session_id", rules.alias("rules")).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("rules") > 0).alias("bad"),
        F.bit_or("rules").alias("rules"),
    )
    copies = F.col("rows") > 1
    totals = per_id.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_records"),
        F.coalesce(F.sum(F.when(copies, F.col("rows")).otherwise(F.col("bad"))), F.lit(0)).alias("invalid_records"),
        F.count_if(copies).alias("duplicate"),
        F.coalesce(F.bit_or("rules"), F.lit(0).cast("long")).alias("rules"),
    )
    orphans = _orphan_chargers(t).scalar()
    violated = F.when(orphans > 0, 1).otherwise(0) + F.when(F.col("duplicate") > 0, 1).otherwise(0)
    violated = violated + F.bit_count("rules")
    valid = F.col("total_records") - F.col("invalid_records")
    return totals.select(
        "total_records",
        valid.alias("valid_records"),
        "invalid_records",
        (m.rate(valid, "total_records") * 100.0).alias("valid_pct"),
        violated.cast("long").alias("warnings"),
    )


def dq_flags(t: Tables) -> DataFrame:
    """Every session row with one flag per session rule, and whether any is set.

    Duplicated ids are joined back as a list of ids; a hot id is split by AQE's
    skew join, the list side having one row for it.
    """
    flags = _local_flags(t.sessions)
    flagged = _with_key_flags(t, t.sessions.select("*", *[f.alias(n) for n, f in flags.items()]))
    copies = (
        t.sessions.groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > 1)
        .select(F.col("session_id").alias("copied_id"), F.lit(True).alias("copied"))
    )
    joined = flagged.join(copies, F.col("session_id").eqNullSafe(F.col("copied_id")), "left")
    joined = joined.withColumn("duplicate", F.coalesce("copied", F.lit(False)))
    invalid = F.lit(False)
    for r in SESSION_RULES:
        invalid = invalid | F.col(r)
    return joined.select(
        "session_id", "station_id", "charger_id", "start_time", *SESSION_RULES, invalid.alias("is_invalid")
    )


def _text_moments(df: DataFrame) -> list[Column]:
    """Timestamp columns that are still text and do not parse, as flags."""
    return [
        F.col(f.name).isNotNull() & F.col(f.name).try_cast("timestamp_ntz").isNull()
        for f in df.schema if f.name in ("start_time", "end_time") and isinstance(f.dataType, T.StringType)
    ]


def raw_scan(t: Tables) -> DataFrame:
    """Per table: rows, records that did not fit the schema, rows with an unparsable timestamp, sessions that end too early.

    For tables of ``load_raw_tables``; each is read once. A timestamp that does not parse counts as missing in the
    quality rules, so it is counted here on its own.
    """
    parts = []
    for name, df in (("stations", t.stations), ("chargers", t.chargers), ("charging_sessions", t.sessions)):
        broken = F.col(BROKEN).isNotNull() if BROKEN in df.columns else F.lit(False)
        unparsed = F.lit(False)
        for flag in _text_moments(df):
            unparsed = unparsed | flag
        late = F.lit(False)
        if "end_time" in df.columns:
            late = F.coalesce(_moment(df, "start_time") >= _moment(df, "end_time"), F.lit(False))
        parts.append(df.agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(broken).alias("unreadable"),
            F.count_if(unparsed).alias("bad_timestamps"), F.count_if(late).alias("late_sessions"),
        ).select(F.lit(name).alias("table_name"), "*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def unreadable_records(t: Tables) -> DataFrame:
    """Every record that did not fit its schema: table_name and the line as it was."""
    parts = [
        df.filter(F.col(BROKEN).isNotNull()).select(F.lit(name).alias("table_name"), F.col(BROKEN).alias("record"))
        for name, df in (("stations", t.stations), ("chargers", t.chargers), ("charging_sessions", t.sessions)) if BROKEN in df.columns
    ]
    if not parts:
        return t.sessions.sparkSession.createDataFrame([], "table_name string, record string")
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found
