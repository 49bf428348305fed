"""Where executors and slots sit, and whether a slot or node can take more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.functions import params as P
from flowscope.functions.text import executor_text
from flowscope.operators.joins import spread_join
from flowscope.operators.numbering import pair_dimensions
from flowscope.operators.rollup import place_pairs, place_slot_pairs
from flowscope.schema import EXECUTOR, SLOT


def declared_slots(params: DataFrame) -> DataFrame:
    """Slots 0..n-1 of every topology, n = least(workers, executors)."""
    last = P.slot_count("workers", "executor_count") - 1
    return params.select("topology_id", F.explode(F.sequence(F.lit(0), last)).alias("slot_id"))


def empty_slots(slots: DataFrame, placement: DataFrame) -> DataFrame:
    return slots.join(placement.select(*SLOT).distinct(), SLOT, "left_anti")


def used_slots(slots: DataFrame, placement: DataFrame) -> DataFrame:
    return slots.join(placement.select(*SLOT).distinct(), SLOT, "left_semi")


def executor_to_slot(executors: DataFrame, placement: DataFrame) -> DataFrame:
    return executors.join(placement.select(*EXECUTOR, "slot_id").hint("merge"), EXECUTOR, "left")


def slot_to_node(slots: DataFrame, slot_node: DataFrame) -> DataFrame:
    return slots.join(slot_node.select(*SLOT, "node"), SLOT, "left")


def _held(a: str, b: str) -> Column:
    return F.array_sort(F.array_compact(F.array_distinct(F.array(a, b))))


def containing_slots(pairs: DataFrame, placement: DataFrame) -> DataFrame:
    """The 0, 1 or 2 slots that hold an end of each executor pair, as ``slots``."""
    return place_pairs(pairs, placement).withColumn("slots", _held("src_slot_id", "dst_slot_id"))


def containing_nodes(slots: DataFrame, slot_node: DataFrame) -> DataFrame:
    """The 0, 1 or 2 nodes that hold a slot of each slot pair, as ``nodes``."""
    return place_slot_pairs(slots, slot_node).withColumn("nodes", _held("node_of_a", "node_of_b"))


def describe_assignment(executors: DataFrame, placement: DataFrame, slot_node: DataFrame) -> DataFrame:
    """``topology_id, host, port, executor`` with executor as ``component[begin,end]``.

    ``executors`` carries ``component``; the port of a slot is its id.
    """
    return (
        executors.select(*EXECUTOR, "component")
        .join(placement.select(*EXECUTOR, "slot_id").hint("merge"), EXECUTOR)
        .join(slot_node, SLOT)
        .select(
            "topology_id",
            F.col("node").alias("host"),
            F.col("slot_id").alias("port"),
            executor_text("component", "begin_task", "end_task").alias("executor"),
        )
    )


def union_ports(ports: DataFrame) -> DataFrame:
    """Distinct (name, port), whether available or in use."""
    available = ports.filter(~F.col("used")).select("name", "port")
    used = ports.filter("used").select("name", "port")
    return available.union(used).distinct()


def ports_per_host(node: DataFrame, ports: DataFrame) -> DataFrame:
    """Every node with its number of distinct ports, 0 if it reports none."""
    counts = union_ports(ports).groupBy("name").agg(F.count(F.lit(1)).cast("int").alias("ports"))
    return (
        node.select("name")
        .join(counts, "name", "left")
        .withColumn("ports", F.coalesce("ports", F.lit(0)))
    )


def slot_limits(params: DataFrame) -> DataFrame:
    """Per topology: slots, executor places per slot and load limit (null: none)."""
    filled = P.default_params(params)
    slots = P.slot_count("workers", "executor_count")
    return filled.select(
        "topology_id",
        slots.alias("slot_count"),
        P.max_executors_per_slot("executor_count", slots, "alfa").alias("max_executors"),
        P.max_load_per_slot("total_load", slots, "gamma").alias("max_load"),
    )


def node_limits(params: DataFrame, node_count: Column) -> DataFrame:
    """Per topology: nodes to use and most slots on one node."""
    filled = P.default_params(params)
    slots = P.slot_count("workers", "executor_count")
    return filled.select(
        "topology_id",
        P.nodes_to_use(node_count, slots, "beta").alias("nodes_to_use"),
        P.max_slots_per_node(node_count, slots, "beta", "delta").alias("max_slots"),
    )


def slot_state(slots: DataFrame, occupancy: DataFrame, limits: DataFrame) -> DataFrame:
    """Declared slots with their occupancy (0 if empty) and their topology's limits."""
    return (
        slots.join(occupancy, SLOT, "left")
        .join(limits, "topology_id")
        .withColumns(
            {
                "executors": F.coalesce("executors", F.lit(0)),
                "load": F.coalesce("load", F.lit(0).cast("long")),
            }
        )
    )


def fits_load(load: Column, extra: Column, limit: Column) -> Column:
    """Null and negative limits mean no limit."""
    return limit.isNull() | (limit < 0) | (load + extra <= limit)


def _others(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def can_accept_slot(
    candidates: DataFrame, state: DataFrame, k: str = "k", extra: str = "x"
) -> DataFrame:
    """Adds ``can_accept`` to (topology, slot, k executors, x load) candidates."""
    places = state.select(
        *SLOT,
        (F.col("max_executors") - F.col("executors")).alias("__places"),
        F.col("load").alias("__load"),
        F.col("max_load").alias("__limit"),
    )
    ok = (F.col("__places") >= F.col(k)) & fits_load(F.col("__load"), F.col(extra), F.col("__limit"))
    return (
        spread_join(candidates, places, SLOT, _others(candidates, SLOT), "inner")
        .withColumn("can_accept", ok)
        .drop("__places", "__load", "__limit")
    )


def can_assign_node(
    candidates: DataFrame,
    nodes: DataFrame,
    slot_node: DataFrame,
    on_node: DataFrame,
    limits: DataFrame,
    black_list: DataFrame | None = None,
) -> DataFrame:
    """Adds ``can_assign`` to (topology, slot, node, load) candidates.

    A node takes a slot it does not hold yet, if it has a free port, can carry
    the load and holds fewer slots of the topology than the limit.
    ``black_list`` (topology, node) removes candidates beforehand.
    """
    if black_list is not None:
        candidates = candidates.join(black_list, ["topology_id", "node"], "left_anti")
    held = slot_node.select(*SLOT, "node", F.lit(True).alias("__held"))
    ok = (
        F.col("__held").isNull()
        & (F.col("__free") > 0)
        & (F.col("__load") + F.col("load") <= F.col("__capacity"))
        & (F.coalesce("__slots", F.lit(0)) < F.col("__max"))
    )
    return (
        candidates.join(held, [*SLOT, "node"], "left")
        .join(
            nodes.select(
                F.col("name").alias("node"),
                F.col("free_ports").alias("__free"),
                F.col("load").alias("__load"),
                F.col("capacity").alias("__capacity"),
            ),
            "node",
        )
        .join(
            on_node.select("node", "topology_id", F.col("slots").alias("__slots")),
            ["topology_id", "node"],
            "left",
        )
        .join(limits.select("topology_id", F.col("max_slots").alias("__max")), "topology_id")
        .withColumn("can_assign", ok)
        .select(*candidates.columns, "can_assign")
    )


def unused_nodes(topology: DataFrame, node: DataFrame, slot_node: DataFrame) -> DataFrame:
    """Per topology the nodes that hold none of its slots (one row per such pair)."""
    every = pair_dimensions(
        topology.select("topology_id"), node.select(F.col("name").alias("node")), "node"
    )
    return every.join(slot_node.select("topology_id", "node"), ["topology_id", "node"], "left_anti")


def component_edges(dag: DataFrame) -> DataFrame:
    """Component graph (``components``, ``streams``) exploded to input edges."""
    return dag.select("topology_id", F.explode("streams").alias("component", "__inputs")).select(
        "topology_id", "component", F.explode("__inputs").alias("input_component")
    )


def upstream_slots(
    dag: DataFrame, placement: DataFrame, state: DataFrame, epsilon: float = 0.5
) -> DataFrame:
    """Slots for each component of a topology: ``primary`` or ``secondary``.

    A slot is primary if it holds an executor of an input component.  Full
    slots are left out.  From component number ``int(epsilon * count)`` on,
    empty secondary slots count as primary (``promoted``).
    """
    components = dag.select(
        "topology_id",
        F.size("components").alias("__count"),
        F.posexplode("components").alias("position", "component"),
    )
    fed = (
        component_edges(dag)
        .join(
            placement.select(
                "topology_id", F.col("component").alias("input_component"), "slot_id"
            ).distinct(),
            ["topology_id", "input_component"],
        )
        .select("topology_id", "component", "slot_id")
        .distinct()
        .withColumn("__fed", F.lit(True))
    )
    open_slots = state.filter(F.col("executors") < F.col("max_executors")).select(
        *SLOT, F.col("executors").alias("__held")
    )
    start = (F.lit(float(epsilon)).cast("float") * F.col("__count").cast("float")).cast("int")
    promoted = F.col("__fed").isNull() & (F.col("__held") == 0) & (F.col("position") >= start)
    return (
        components.join(open_slots, "topology_id")
        .join(fed, ["topology_id", "component", "slot_id"], "left")
        .select(
            "topology_id",
            "component",
            "slot_id",
            F.when(F.col("__fed") | promoted, "primary").otherwise("secondary").alias("slot_class"),
            promoted.alias("promoted"),
        )
    )
