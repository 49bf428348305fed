"""The three standing reports, each one lazy plan over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.operators import history, placement, rollup, series, sets, whatif
from flowscope.operators.joins import spread_join


def monitoring_cycle(
    receipts: DataFrame, topology: DataFrame, slot: str, slots: int, slot_length: int
) -> DataFrame:
    """Receipts to the traffic table: each pair's newest moving rate.

    Counts per slot, rate over the last ``slots`` present slots, newest per pair.
    """
    counts = series.tuple_counts(receipts, slot)
    keys = ["topology_key", "source_task", "destination_task"]
    rates = series.moving_rate(counts, keys, ["slot_start"], "tuples", slots, slot_length)
    newest = series.latest_sample(rates, keys, ["slot_start"], ["rate"])
    return spread_join(
        newest, topology, ["topology_key"], ["source_task", "destination_task"], "inner"
    ).select(
        "topology_id", "source_task", "destination_task", F.col("rate").cast("int").alias("traffic")
    )


def load_cycle(
    samples: DataFrame, thread_tasks: DataFrame, clock_hz: int, slots: int, slot_length: int
) -> DataFrame:
    """Counter samples to the load table: each executor's newest moving load."""
    cycles = series.counter_delta(samples, clock_hz)
    rates = series.moving_rate(
        cycles, ["thread_id"], ["ts", "event_id"], "cycles", slots, slot_length
    )
    newest = series.latest_sample(rates, ["thread_id"], ["ts", "event_id"], ["rate"])
    return rollup.executor_ranges(thread_tasks).join(newest, "thread_id").select(
        "thread_id", "begin_task", "end_task", F.col("rate").alias("load")
    )


def evaluation_summary(
    topology: DataFrame,
    live: DataFrame,
    traffic: DataFrame,
    load: DataFrame,
    executors_on_slots: DataFrame,
    slot_node: DataFrame,
    node: DataFrame,
    params: DataFrame,
) -> DataFrame:
    """One row per active topology: is its data complete, and how is it spread.

    Load, number of communicating pairs, traffic between slots, nodes in use
    and how many more its parameters ask for.
    """
    pairs = rollup.executor_traffic(traffic, load)
    counts = pairs.groupBy("topology_id").agg(F.count(F.lit(1)).alias("pairs"))
    cut = rollup.slot_traffic_total(rollup.slot_traffic(pairs, executors_on_slots))
    spread = rollup.nodes_of_topology(slot_node).select("topology_id", "node_count")
    gap = whatif.node_spread_gap(params, slot_node, node).select("topology_id", "gap")
    return (
        rollup.total_load(load, sets.active_topologies(topology, live))
        .join(counts, "topology_id", "left")
        .join(cut.withColumnRenamed("traffic", "cut"), "topology_id", "left")
        .join(spread, "topology_id", "left")
        .join(gap, "topology_id", "left")
        .select(
            "topology_id",
            "topology_key",
            "total_load",
            F.col("pairs").isNotNull().alias("complete"),
            F.coalesce("pairs", F.lit(0)).alias("pairs"),
            F.coalesce("cut", F.lit(0)).alias("cut"),
            F.coalesce("node_count", F.lit(0)).alias("node_count"),
            F.coalesce("gap", F.lit(0)).alias("gap"),
        )
    )


def tracked_assignment(
    executors: DataFrame, executors_on_slots: DataFrame, slot_node: DataFrame, topology: DataFrame
) -> DataFrame:
    """The present placement in the text form of the assignment log.

    One row per topology and host; in host order they make the whole text.
    """
    described = placement.describe_assignment(executors, executors_on_slots, slot_node)
    text = history.serialize_hosts(described, ["topology_id"])
    return text.join(topology, "topology_id").select("topology_key", "host", "assignment")
