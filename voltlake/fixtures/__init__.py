"""Test support: the driver's tables read as a charging network, in Spark and in DuckDB SQL."""
