"""The three tables: schemas, readers, writer, size-checked broadcasting."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
DATE_FORMAT = "yyyy-MM-dd"

STATIONS = T.StructType([
    T.StructField("station_id", T.StringType()),
    T.StructField("station_name", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("area", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("total_chargers", T.IntegerType()),
    T.StructField("station_type", T.StringType()),
])

CHARGERS = T.StructType([
    T.StructField("charger_id", T.StringType()),
    T.StructField("station_id", T.StringType()),
    T.StructField("charger_type", T.StringType()),
    T.StructField("power_kw", T.DoubleType()),
    T.StructField("installation_date", T.DateType()),
    T.StructField("charger_status", T.StringType()),
])

SESSIONS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("station_id", T.StringType()),
    T.StructField("charger_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("vehicle_type", T.StringType()),
    T.StructField("start_time", T.TimestampNTZType()),
    T.StructField("end_time", T.TimestampNTZType()),
    T.StructField("duration_minutes", T.IntegerType()),
    T.StructField("energy_kwh", T.DoubleType()),
    T.StructField("price_per_kwh", T.DoubleType()),
    T.StructField("revenue", T.DoubleType()),
    T.StructField("session_status", T.StringType()),
    T.StructField("payment_status", T.StringType()),
])

SESSION_COLUMNS = tuple(SESSIONS.names)
FILES = {"stations": STATIONS, "chargers": CHARGERS, "charging_sessions": SESSIONS}
MONTH_PARTITION = "start_month"
#: Of raw CSV tables: the line of a record that does not fit the schema, else NULL.
BROKEN = "broken_record"


@dataclass(frozen=True)
class Tables:
    """Stations, chargers and charging sessions; sessions are the fact.

    ``months`` are the month directories of the sessions, newest first, where they are stored so.
    """

    stations: DataFrame
    chargers: DataFrame
    sessions: DataFrame
    months: tuple[dt.date, ...] = ()


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate (file sizes at the leaves); None where it cannot be read."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except (AttributeError, TypeError):
        return None


def _threshold_bytes(spark: SparkSession) -> int:
    value = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").lower()
    factor = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = value.rstrip("bkmg")
    suffix = value[len(digits):].rstrip("b")
    return int(digits) * factor.get(suffix, 1)


def broadcast_if_small(df: DataFrame, measured: DataFrame | None = None, growth: int = 1) -> DataFrame:
    """Hint a broadcast only where the size is known to be below the session's threshold.

    The size is that of ``measured`` times ``growth``: a table derived by joins
    or ``explode`` has no usable estimate of its own, the files it comes from do.
    Larger tables are returned as they are and join by shuffle (AQE splits hot keys).
    """
    size = estimated_bytes(df if measured is None else measured)
    limit = _threshold_bytes(df.sparkSession)
    return F.broadcast(df) if size is not None and 0 <= size * growth <= limit else df


def fits_broadcast(df: DataFrame) -> bool:
    """Whether a join will broadcast ``df``: it carries the hint, or its estimate is below the session's threshold.

    An unknown size counts as small: the join is then left to Catalyst and AQE.
    """
    limit = _threshold_bytes(df.sparkSession)
    size = estimated_bytes(df)
    if size is None:
        return True
    hinted = "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()
    return hinted or size <= limit


def _location(path: str, name: str, fmt: str) -> str:
    return f"{path.rstrip('/')}/{name}.csv" if fmt == "csv" else f"{path.rstrip('/')}/{name}"


def _read(
    spark: SparkSession, path: str, name: str, fmt: str, schema: T.StructType, strict: bool, header: bool = True
) -> DataFrame:
    if fmt == "parquet":
        # The files' own types: ids may be text or numbers. The month directories stay a column, for pruning.
        table = spark.read.parquet(_location(path, name, fmt))
        return table.select(*[c for c in (*schema.names, MONTH_PARTITION) if c in table.columns])
    if fmt != "csv":
        raise ValueError("fmt must be 'csv' or 'parquet'")
    if not strict:
        return _rescued(spark, _location(path, name, fmt), schema, header)
    return (
        spark.read.schema(schema).option("header", header)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
        .option("dateFormat", DATE_FORMAT)
        .option("mode", "FAILFAST")
        .csv(_location(path, name, fmt))
    )


def _rescued(spark: SparkSession, location: str, schema: T.StructType, header: bool) -> DataFrame:
    """Lines of CSV as columns, with the line itself in ``BROKEN`` where it does not fit.

    The CSV source converts only the columns a query asks for, so a record would be broken in one query and whole
    in another. Here every line is parsed whole, whatever is asked for. A header is a line of the schema's names.
    """
    lines = spark.read.text(location).filter(F.length(F.trim("value")) > 0)
    if header:
        lines = lines.filter(F.col("value") != ",".join(schema.names))
    fields = T.StructType([*schema, T.StructField(BROKEN, T.StringType())])
    options = {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN,
        "timestampNTZFormat": TIMESTAMP_FORMAT, "dateFormat": DATE_FORMAT,
    }
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return lines.select(F.from_csv("value", typed, options).alias("record")).select("record.*")


def load_tables(spark: SparkSession, path: str, fmt: str = "csv") -> Tables:
    """Typed tables, of CSV or of what :func:`write_tables` wrote as parquet.

    CSV columns have the types of the schemas above, parquet columns those they were written with. An
    unreadable timestamp in CSV fails the query that meets it.
    """
    stations, chargers, sessions = (
        _read(spark, path, name, fmt, schema, strict=True) for name, schema in FILES.items()
    )
    return Tables(stations, chargers, sessions, _months(sessions))


def _months(sessions: DataFrame) -> tuple[dt.date, ...]:
    """Month directories with files, newest first, from the listing Spark made when it opened the table."""
    if MONTH_PARTITION not in sessions.columns:
        return ()
    named = (re.search(rf"/{MONTH_PARTITION}=(\d{{4}}-\d\d-\d\d)/", file) for file in sessions.inputFiles())
    return tuple(sorted({dt.date.fromisoformat(found.group(1)) for found in named if found}, reverse=True))


def load_raw_tables(spark: SparkSession, path: str, fmt: str = "csv", header: bool = True) -> Tables:
    """Tables for the quality scan: start and end stay text, nothing is rejected on reading.

    A CSV record that does not fit (a number that is none, too few or too many fields) comes back with what could be
    read of it, NULL elsewhere, and its whole line in the column ``broken_record``.
    """
    as_text = T.StructType([
        T.StructField(f.name, T.StringType()) if f.name in ("start_time", "end_time") else f for f in SESSIONS
    ])
    schemas = {**FILES, "charging_sessions": as_text if fmt == "csv" else SESSIONS}
    stations, chargers, sessions = (
        _read(spark, path, name, fmt, schema, strict=False, header=header) for name, schema in schemas.items()
    )
    return Tables(stations, chargers, sessions)


def write_tables(t: Tables, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Write the three tables.

    Parquet sessions are partitioned by start month, so date filters prune
    directories; the rebalance hint lets AQE split a hot month over several tasks
    and merge small ones. CSV is written with a header, in the reader's formats.
    """
    for name, df in zip(FILES, (t.stations, t.chargers, t.sessions)):
        target = _location(path, name, fmt)
        if fmt == "csv":
            (
                df.write.mode(mode).option("header", True)
                .option("timestampNTZFormat", TIMESTAMP_FORMAT).option("dateFormat", DATE_FORMAT)
                .csv(target)
            )
        elif fmt == "parquet" and name == "charging_sessions":
            (
                df.withColumn(MONTH_PARTITION, F.trunc(F.to_date("start_time"), "month"))
                .hint("rebalance", MONTH_PARTITION)
                .write.mode(mode).partitionBy(MONTH_PARTITION).parquet(target)
            )
        elif fmt == "parquet":
            df.write.mode(mode).parquet(target)
        else:
            raise ValueError("fmt must be 'csv' or 'parquet'")
