"""The driver's parquet tables mapped to stations, chargers and sessions (FIXTURES.md section 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.sources.tables import SESSION_COLUMNS, Tables, broadcast_if_small

EPOCH = "TIMESTAMP_NTZ'2024-10-01 00:00:00'"

# Rows derived from one supplier: a station, and up to 19 chargers of about 60 bytes.
STATION_GROWTH = 8
CHARGER_GROWTH = 64


# Column types of the files, so that opening a table starts no job.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT",
    "part": "p_partkey BIGINT, p_brand STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
    " l_extendedprice DOUBLE, l_shipdate TIMESTAMP_NTZ",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation")
    region = _table(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = _table(spark, sf_dir, "supplier")
    return supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "s_suppkey AS station_id",
        "s_name AS station_name",
        "n_name AS city",
        "r_name AS area",
        "24.5D + (s_suppkey * 37 % 2400) / 100.0D AS latitude",
        "-124.0D + (s_suppkey * 53 % 5700) / 100.0D AS longitude",
        "4 + s_suppkey % 16 AS total_chargers",
        "CASE s_suppkey % 4 WHEN 0 THEN 'Highway' WHEN 1 THEN 'Urban' WHEN 2 THEN 'Retail'"
        " ELSE 'Workplace' END AS station_type",
    )


def _chargers(stations: DataFrame) -> DataFrame:
    slots = stations.selectExpr("station_id", "explode(sequence(0, total_chargers - 1)) AS k")
    return slots.selectExpr(
        "station_id * 100 + k AS charger_id",
        "station_id",
        "CASE k % 4 WHEN 0 THEN 'Level 2 (AC)' WHEN 1 THEN 'DC Fast (50kW)'"
        " WHEN 2 THEN 'DC Ultra-Fast (150kW+)' ELSE 'DC Hyper-Fast (350kW)' END AS charger_type",
        "CAST(CASE k % 4 WHEN 0 THEN 11 WHEN 1 THEN 50 WHEN 2 THEN 150 ELSE 350 END AS DOUBLE) AS power_kw",
        "CASE WHEN station_id % 25 = 24 THEN 'Offline'"
        " WHEN (station_id * 7 + k * 3) % 100 < 90 THEN 'Active'"
        " WHEN (station_id * 7 + k * 3) % 100 < 97 THEN 'Maintenance' ELSE 'Offline' END AS charger_status",
    )


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per line item; status, minutes and energy follow from ``u``.

    Price and date become the small numbers that are needed of them before the joins shuffle the line items. FLOOR
    and datediff never raise, so a row that joins nothing cannot fail; casts that may are left to the joined rows.
    """
    lineitem = _table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "FLOOR(l_extendedprice / 12) AS dozens",
        "datediff(l_shipdate, DATE'1995-01-01') % 365 AS dd",
    )
    orders = _table(spark, sf_dir, "orders")
    part = _table(spark, sf_dir, "part")
    joined = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )
    drawn = joined.selectExpr(
        "l_orderkey * 10 + l_linenumber AS session_id",
        "l_suppkey AS station_id",
        "l_suppkey * 100 + l_partkey % (4 + l_suppkey % 16) AS charger_id",
        "o_custkey AS customer_id",
        "p_brand AS vehicle_type",
        "dd",
        "CAST((l_partkey % 12 + l_orderkey % 13) * 60"
        " + (l_orderkey * 7 + l_linenumber * 13) % 60 AS INT) AS minute_of_day",
        "CAST(l_quantity AS INT) AS q",
        "l_partkey AS pk",
        "CAST(dozens AS INT) AS e100",
        "(l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7 + l_suppkey * 3) % 100 AS u",
    )
    shaped = drawn.selectExpr(
        "*",
        "CASE WHEN u < 90 THEN 10 + q * 9 WHEN u < 98 THEN 1 + q % 9"
        " WHEN pk % 2 = 0 THEN 300 + q * 20 ELSE 5 + q % 10 END AS duration_minutes",
        "CASE WHEN u < 90 THEN e100 WHEN u < 98 THEN pk % 8 * 25"
        " WHEN pk % 2 = 0 THEN 100 + pk % 400 ELSE 20000 + q * 600 END AS energy_c",
        "30 + pk % 36 AS price_c",
    )
    return shaped.selectExpr(
        "session_id", "station_id", "charger_id", "customer_id", "vehicle_type",
        f"{EPOCH} + INTERVAL '1' MINUTE * (dd * 1440 + minute_of_day) AS start_time",
        f"{EPOCH} + INTERVAL '1' MINUTE * (dd * 1440 + minute_of_day + duration_minutes) AS end_time",
        "duration_minutes",
        "energy_c / 100.0D AS energy_kwh",
        "price_c / 100.0D AS price_per_kwh",
        "CASE WHEN u < 90 THEN energy_c * price_c / 10000.0D ELSE 0.0D END AS revenue",
        "CASE WHEN u < 90 THEN 'Completed' WHEN u < 95 THEN 'Failed' WHEN u < 98 THEN 'Cancelled'"
        " ELSE 'Abnormal' END AS session_status",
        "CASE WHEN u < 90 THEN 'Paid' WHEN u < 95 THEN 'Refunded' WHEN u < 98 THEN 'Voided'"
        " ELSE 'Pending' END AS payment_status",
    ).select(*SESSION_COLUMNS)


def _dimensions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    supplier = _table(spark, sf_dir, "supplier")
    stations = _stations(spark, sf_dir)
    return (
        broadcast_if_small(stations, supplier, STATION_GROWTH),
        broadcast_if_small(_chargers(stations), supplier, CHARGER_GROWTH),
    )


def network(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables as they should be."""
    stations, chargers = _dimensions(spark, sf_dir)
    return Tables(stations, chargers, _sessions(spark, sf_dir))


def faulty_network(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables with planted faults, for the quality rules."""
    stations, chargers = _dimensions(spark, sf_dir)
    broken_chargers = chargers.withColumn(
        "station_id", F.expr("CASE WHEN charger_id % 97 = 0 THEN station_id + 100000 ELSE station_id END")
    )
    broken = _sessions(spark, sf_dir).selectExpr(
        "session_id",
        "CASE WHEN session_id % 211 = 0 THEN station_id + 100000 WHEN session_id % 227 = 0"
        " THEN station_id + 1 ELSE station_id END AS station_id",
        "CASE WHEN session_id % 223 = 0 THEN charger_id + 90000000 ELSE charger_id END AS charger_id",
        "customer_id",
        "CASE WHEN session_id % 251 = 0 THEN NULL ELSE vehicle_type END AS vehicle_type",
        "start_time",
        "CASE WHEN session_id % 241 = 0 THEN start_time ELSE end_time END AS end_time",
        "CASE WHEN session_id % 239 = 0 THEN 0 ELSE duration_minutes END AS duration_minutes",
        "CASE WHEN session_id % 229 = 0 THEN -energy_kwh - 1 ELSE energy_kwh END AS energy_kwh",
        "price_per_kwh",
        "CASE WHEN session_id % 233 = 0 THEN -revenue - 1 ELSE revenue END AS revenue",
        "session_status",
        "payment_status",
    )
    return Tables(stations, broken_chargers, broken)
