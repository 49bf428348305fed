"""Reconciling the topologies in the statistics with the live ones."""

from __future__ import annotations

from pyspark.sql import DataFrame


def stale_topologies(known: DataFrame, live: DataFrame) -> DataFrame:
    """Known topologies that are no longer live."""
    return known.join(live.select("topology_key"), "topology_key", "left_anti")


def active_topologies(known: DataFrame, live: DataFrame) -> DataFrame:
    """Known topologies that are live."""
    return known.join(live.select("topology_key"), "topology_key", "left_semi")
