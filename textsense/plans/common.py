"""Readers for the driver tables used by the registered queries."""

from __future__ import annotations

from ..session import read_table, spread


def table(spark, sf, name, spread_rows: bool = True):
    """Scan a driver table. ``spread_rows``: tables with costly row work follow the session's
    setting for dealing scans (``session.SCAN_PARTITIONS``; by default a scan keeps its splits)."""
    df = read_table(spark, sf, name)
    return spread(df) if spread_rows else df
