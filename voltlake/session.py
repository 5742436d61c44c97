"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# All of them can be changed at runtime. Shuffle partitions are left to the cluster; AQE
# coalesces them.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HotSpot does not compile methods above 8,000 bytes of bytecode. A fused stage with many
    # conditional measures can exceed that and would be interpreted; split operators are not.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
