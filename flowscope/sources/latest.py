"""Latest value per key from append-only change logs, and key registration.

Parquet has no in-place update.  Every store operation appends rows with a
version; the current table is the newest row per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.operators.numbering import number_keys
from flowscope.schema import EXECUTOR

TRAFFIC_KEY = ["topology_id", "source_task", "destination_task"]


def latest(log: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The newest row per key; ``version`` columns order the rows of a key."""
    rest = [c for c in log.columns if c not in keys and c not in version]
    newest = F.max_by(F.struct(*rest), F.struct(*version)).alias("__row")
    return log.groupBy(*keys).agg(newest).select(*keys, "__row.*")


def latest_load(log: DataFrame, version: Sequence[str] = ("version",)) -> DataFrame:
    return latest(log, EXECUTOR, version)


def latest_traffic(log: DataFrame, version: Sequence[str] = ("version",)) -> DataFrame:
    return latest(log, TRAFFIC_KEY, version)


def upsert_node(current: DataFrame, incoming: DataFrame, version: Sequence[str] = ()) -> DataFrame:
    """Node registration: a known node takes the newest capacity and keeps its cores.

    A node may register many times, once for each of its workers: the oldest registration of
    a new node gives its cores.  ``version`` columns order them; without any, and among
    equal versions, the order is that of (capacity, cores).
    """
    order = F.struct(*version, "capacity", "cores")
    new = incoming.groupBy("name").agg(
        F.max_by("capacity", order).alias("__capacity"), F.min_by("cores", order).alias("__cores")
    )
    return current.join(new, "name", "full").select(
        "name",
        F.coalesce("__capacity", "capacity").alias("capacity"),
        F.coalesce("cores", "__cores").alias("cores"),
    )


def register_topologies(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Get-or-create: known keys keep their id, new ones follow the highest id."""
    new = incoming.select("topology_key").distinct()
    new = new.join(current.select("topology_key"), "topology_key", "left_anti")
    top = current.agg(F.max("topology_id").alias("top"))
    numbered = number_keys(new, "topology_key", top).withColumnRenamed("id", "topology_id")
    return current.select("topology_id", "topology_key").unionByName(numbered)


def purge(df: DataFrame, stale: DataFrame) -> DataFrame:
    """A table without the rows of stale topologies (``topology_id``)."""
    return df.join(stale.select("topology_id"), "topology_id", "left_anti")
