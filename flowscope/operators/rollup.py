"""Loads and traffic rolled up from tasks to executors, slots and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.operators.joins import spread_join
from flowscope.operators.resolve import is_resolved, resolve_edges
from flowscope.schema import EXECUTOR, EXECUTOR_PAIR, SLOT

# An adjacency list is cut into pages of this many task ids of the neighbour,
# so a hub with very many neighbours becomes several rows, none of them huge.
PAGE = 4096


def total_load(load: DataFrame, topology: DataFrame) -> DataFrame:
    """Summed load per topology, 0 without rows; summed before the join."""
    sums = load.groupBy("topology_id").agg(F.sum("load").alias("total_load"))
    return topology.join(sums, "topology_id", "left").withColumn(
        "total_load", F.coalesce("total_load", F.lit(0))
    )


def node_load(load: DataFrame, node: DataFrame) -> DataFrame:
    """Known nodes that carry load: ``name, capacity, cores, total_load``."""
    sums = load.groupBy(F.col("node").alias("name")).agg(F.sum("load").alias("total_load"))
    return sums.join(node, "name")


def overloaded_nodes(load: DataFrame, node: DataFrame) -> DataFrame:
    return node_load(load, node).filter(F.col("total_load") > F.col("capacity"))


def executor_traffic(
    traffic: DataFrame, executors: DataFrame, complete_only: bool = True
) -> DataFrame:
    """Directed executor-pair traffic, self pairs kept.

    With ``complete_only`` a topology with any unresolved task is left out as a
    whole: its statistics are still arriving.
    """
    # Keys are never null; saying so on both sides of the anti join below keeps
    # their scans identical.
    edges = resolve_edges(traffic.filter(F.col("topology_id").isNotNull()), executors)
    pairs = edges.groupBy(*EXECUTOR_PAIR).agg(
        F.sum("traffic").alias("traffic"), F.bool_and(is_resolved()).alias("__resolved")
    )
    if complete_only:
        # Both filters are on sums, not on keys, and both need all of them: the
        # shuffled partial sums stay the same on either side and are reused.
        summed = F.col("traffic").isNotNull()
        broken = pairs.filter(summed & ~F.col("__resolved")).select("topology_id").distinct()
        pairs = spread_join(pairs, broken, ["topology_id"], EXECUTOR_PAIR[1:], "left_anti")
    return pairs.filter("__resolved").drop("__resolved")


def complete_topologies(traffic: DataFrame, executors: DataFrame) -> DataFrame:
    """Topologies all of whose traffic tasks are owned by an executor."""
    return (
        resolve_edges(traffic, executors)
        .groupBy("topology_id")
        .agg(F.bool_and(is_resolved()).alias("complete"))
        .filter("complete")
        .select("topology_id")
    )


def cross_node_edges(traffic: DataFrame, load: DataFrame) -> DataFrame:
    """Resolved edges whose ends sit on different nodes."""
    edges = resolve_edges(traffic, load, keep=["node"])
    return edges.filter(F.col("src_node") != F.col("dst_node"))


def inter_node_traffic(traffic: DataFrame, load: DataFrame) -> DataFrame:
    """One number over all topologies, 0 when nothing crosses."""
    return cross_node_edges(traffic, load).agg(
        F.coalesce(F.sum("traffic"), F.lit(0)).alias("traffic")
    )


def inter_node_traffic_by_topology(
    traffic: DataFrame, load: DataFrame, topology: DataFrame
) -> DataFrame:
    sums = cross_node_edges(traffic, load).groupBy("topology_id").agg(F.sum("traffic").alias("traffic"))
    return topology.join(sums, "topology_id", "left").withColumn(
        "traffic", F.coalesce("traffic", F.lit(0))
    )


def place_pairs(pairs: DataFrame, placement: DataFrame, column: str = "slot_id") -> DataFrame:
    """Adds ``src_<column>`` and ``dst_<column>`` of both executors, null if unplaced."""

    def side(prefix: str) -> DataFrame:
        return placement.select(
            "topology_id",
            F.col("begin_task").alias(f"{prefix}_begin"),
            F.col("end_task").alias(f"{prefix}_end"),
            F.col(column).alias(f"{prefix}_{column}"),
        )

    src, dst = ["src_begin", "src_end"], ["dst_begin", "dst_end"]
    at_source = spread_join(pairs, side("src"), ["topology_id", *src], dst, grows=True)
    return spread_join(at_source, side("dst"), ["topology_id", *dst], src, grows=True)


def slot_traffic(pairs: DataFrame, placement: DataFrame) -> DataFrame:
    """Undirected slot-pair traffic per topology; traffic inside a slot is not counted."""
    return (
        place_pairs(pairs, placement)
        .filter(F.col("src_slot_id") != F.col("dst_slot_id"))
        .groupBy(
            "topology_id",
            F.least("src_slot_id", "dst_slot_id").alias("slot_a"),
            F.greatest("src_slot_id", "dst_slot_id").alias("slot_b"),
        )
        .agg(F.sum("traffic").alias("traffic"))
    )


def place_slot_pairs(slots: DataFrame, slot_node: DataFrame) -> DataFrame:
    """Adds ``node_of_a`` and ``node_of_b``, null if the slot is unplaced."""

    def side(letter: str) -> DataFrame:
        return slot_node.select(
            "topology_id",
            F.col("slot_id").alias(f"slot_{letter}"),
            F.col("node").alias(f"node_of_{letter}"),
        )

    return slots.join(side("a"), ["topology_id", "slot_a"], "left").join(
        side("b"), ["topology_id", "slot_b"], "left"
    )


def node_traffic(slots: DataFrame, slot_node: DataFrame) -> DataFrame:
    """Undirected node-pair traffic over all topologies."""
    return (
        place_slot_pairs(slots, slot_node)
        .filter(F.col("node_of_a") != F.col("node_of_b"))
        .groupBy(
            F.least("node_of_a", "node_of_b").alias("node_a"),
            F.greatest("node_of_a", "node_of_b").alias("node_b"),
        )
        .agg(F.sum("traffic").alias("traffic"))
    )


def slot_traffic_total(slots: DataFrame) -> DataFrame:
    return slots.groupBy("topology_id").agg(F.sum("traffic").alias("traffic"))


def node_traffic_total(nodes: DataFrame, slot_node: DataFrame) -> DataFrame:
    """Inter-node total of a placement: 0 if nothing crosses, null if nothing is placed."""
    placed = slot_node.agg(F.count(F.lit(1)).alias("n"))
    summed = nodes.agg(F.coalesce(F.sum("traffic"), F.lit(0)).alias("traffic"))
    return summed.select(F.when(placed.scalar() > 0, F.col("traffic")).alias("traffic"))


def executor_ranges(thread_tasks: DataFrame) -> DataFrame:
    """The executor of a thread spans the tasks seen on it."""
    return thread_tasks.groupBy("thread_id").agg(
        F.min("task_id").alias("begin_task"), F.max("task_id").alias("end_task")
    )


def executor_adjacency(pairs: DataFrame, page: int = PAGE) -> DataFrame:
    """Incident edges of every executor, under both ends; a self edge once.

    One row per page of neighbour ids: ``begin_task, end_task, page, degree,
    traffic, edges``.  Pages of an executor in order make its whole list.
    """
    ends = F.explode(
        F.array_distinct(
            F.array(
                F.struct(F.col("src_begin").alias("b"), F.col("src_end").alias("e")),
                F.struct(F.col("dst_begin").alias("b"), F.col("dst_end").alias("e")),
            )
        )
    )
    listed = pairs.withColumn("__end", ends).withColumn(
        "__other",
        F.when(
            (F.col("__end.b") == F.col("src_begin")) & (F.col("__end.e") == F.col("src_end")),
            F.col("dst_begin"),
        ).otherwise(F.col("src_begin")),
    )
    return _paged(
        listed,
        ["topology_id", F.col("__end.b").alias("begin_task"), F.col("__end.e").alias("end_task")],
        F.col("__other"),
        F.struct("src_begin", "src_end", "dst_begin", "dst_end", "traffic"),
        page,
    )


def slot_adjacency(slots: DataFrame, page: int = PAGE) -> DataFrame:
    """Incident slot pairs of every slot, listed under both slots."""
    listed = slots.withColumn("__end", F.explode(F.array("slot_a", "slot_b"))).withColumn(
        "__other",
        F.when(F.col("__end") == F.col("slot_a"), F.col("slot_b")).otherwise(F.col("slot_a")),
    )
    return _paged(
        listed,
        ["topology_id", F.col("__end").alias("slot_id")],
        F.col("__other"),
        F.struct("slot_a", "slot_b", "traffic"),
        page,
    )


def _paged(listed: DataFrame, keys: list, other, edge, page: int) -> DataFrame:
    return listed.groupBy(
        *keys, F.call_function("div", other, F.lit(page)).cast("int").alias("page")
    ).agg(
        F.count(F.lit(1)).alias("degree"),
        F.sum("traffic").alias("traffic"),
        F.array_sort(F.collect_list(edge)).alias("edges"),
    )


def slot_occupancy(placement: DataFrame) -> DataFrame:
    return placement.groupBy(*SLOT).agg(
        F.count(F.lit(1)).cast("int").alias("executors"), F.sum("load").alias("load")
    )


def node_occupancy(
    node: DataFrame, slot_node: DataFrame, slot_loads: DataFrame, ports: DataFrame
) -> DataFrame:
    """Per node: slots placed, their load, total and free ports."""
    used = (
        slot_node.join(slot_loads.select(*SLOT, "load"), SLOT, "left")
        .groupBy(F.col("node").alias("name"))
        .agg(F.count(F.lit(1)).cast("int").alias("slots"), F.sum("load").alias("load"))
    )
    zero = F.lit(0)
    return (
        node.join(used, "name", "left")
        .join(ports, "name", "left")
        .select(
            "name",
            "capacity",
            F.coalesce("slots", zero).alias("slots"),
            F.coalesce("load", zero.cast("long")).alias("load"),
            F.coalesce("ports", zero).alias("ports"),
            (F.coalesce("ports", zero) - F.coalesce("slots", zero)).alias("free_ports"),
        )
    )


def topology_slots_on_node(slot_node: DataFrame) -> DataFrame:
    return slot_node.groupBy("node", "topology_id").agg(F.count(F.lit(1)).cast("int").alias("slots"))


def nodes_of_topology(slot_node: DataFrame) -> DataFrame:
    """Distinct first, so a list never sees more than the nodes of the cluster."""
    return (
        slot_node.select("topology_id", "node")
        .distinct()
        .groupBy("topology_id")
        .agg(
            F.count(F.lit(1)).cast("int").alias("node_count"),
            F.array_sort(F.collect_list("node")).alias("nodes"),
        )
    )


def slots_of_node(slot_node: DataFrame) -> DataFrame:
    """A node holds at most as many slots as it has ports."""
    return slot_node.groupBy("node").agg(
        F.count(F.lit(1)).cast("int").alias("slot_count"),
        F.array_sort(F.collect_list(F.struct(*SLOT))).alias("slots"),
    )


def executor_nodes(placement: DataFrame, slot_node: DataFrame) -> DataFrame:
    """Executors with the node of their slot, null if the slot is unplaced."""
    on_slots = placement.select(*EXECUTOR, "load", "slot_id")
    # Where a caller wants nodes only this becomes an inner join, and the executors its smaller side.
    return spread_join(on_slots, slot_node, SLOT, EXECUTOR[1:], grows=True)
