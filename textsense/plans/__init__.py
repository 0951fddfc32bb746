"""Registered queries: each pairs a Spark job on the driver tables with equivalent DuckDB SQL."""
