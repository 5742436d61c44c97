"""Charging-network analytics as Spark DataFrame operators."""

from voltlake.sources.filters import ALL, GlobalFilter
from voltlake.sources.tables import Tables, load_raw_tables, load_tables, write_tables

__all__ = ["ALL", "GlobalFilter", "Tables", "load_raw_tables", "load_tables", "write_tables"]
