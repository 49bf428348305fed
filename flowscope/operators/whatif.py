"""What a different placement would change, scored for all candidates at once.

``w(e, f)`` is the traffic between two executors in both directions and the
affinity ``A(e, s)`` the sum of ``w(e, f)`` over the executors ``f`` in slot
``s``.  Moving ``e`` from slot ``a`` to ``b`` changes the cut traffic by
``A(e, a) - A(e, b)``; nothing is tried and undone.  The same algebra holds one
level up, with slots on nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.functions import params as P
from flowscope.operators.choose import least_loaded_unused_node
from flowscope.operators.joins import spread_join
from flowscope.operators.placement import empty_slots, fits_load, node_limits
from flowscope.operators.rollup import (
    inter_node_traffic,
    node_load,
    nodes_of_topology,
    overloaded_nodes,
    place_pairs,
    place_slot_pairs,
    slot_traffic,
    slot_traffic_total,
    topology_slots_on_node,
)
from flowscope.schema import EXECUTOR, SLOT


def _zero() -> Column:
    return F.lit(0).cast("long")


def _is_self() -> Column:
    return (F.col("src_begin") == F.col("dst_begin")) & (F.col("src_end") == F.col("dst_end"))


def partner_slots(pairs: DataFrame, placement: DataFrame) -> DataFrame:
    """Both executors of every pair, each with the slot of the other (null if unplaced) and the traffic."""
    ends = F.array(
        F.struct(
            F.col("src_begin").alias("begin_task"),
            F.col("src_end").alias("end_task"),
            F.col("dst_slot_id").alias("slot_id"),
        ),
        F.struct(
            F.col("dst_begin").alias("begin_task"),
            F.col("dst_end").alias("end_task"),
            F.col("src_slot_id").alias("slot_id"),
        ),
    )
    return (
        place_pairs(pairs.filter(~_is_self()), placement)
        .select("topology_id", F.inline(ends), "traffic")
    )


def affinity(pairs: DataFrame, placement: DataFrame) -> DataFrame:
    """Traffic of each executor with the executors of each slot (itself excluded)."""
    return (
        partner_slots(pairs, placement)
        .filter(F.col("slot_id").isNotNull())
        .groupBy(*EXECUTOR, "slot_id")
        .agg(F.sum("traffic").alias("affinity"))
    )


def slot_affinity(slots: DataFrame, slot_node: DataFrame) -> DataFrame:
    """Traffic of each slot with the slots of its topology on each node."""
    ends = F.array(
        F.struct(F.col("slot_a").alias("slot_id"), F.col("node_of_b").alias("node")),
        F.struct(F.col("slot_b").alias("slot_id"), F.col("node_of_a").alias("node")),
    )
    return (
        place_slot_pairs(slots, slot_node)
        .select("topology_id", F.inline(ends), "traffic")
        .filter(F.col("node").isNotNull())
        .groupBy(*SLOT, "node")
        .agg(F.sum("traffic").alias("affinity"))
    )


def home_affinity(placement: DataFrame, aff: DataFrame) -> DataFrame:
    """Placed executors with their traffic into their own slot."""
    return placement.join(aff, [*EXECUTOR, "slot_id"], "left").withColumn(
        "affinity", F.coalesce("affinity", _zero())
    )


def score_moves(
    pairs: DataFrame,
    placement: DataFrame,
    candidates: DataFrame | None = None,
    slots: DataFrame | None = None,
) -> DataFrame:
    """Change in cut traffic if an executor moves: ``from_slot, to_slot, delta``.

    Slots an executor shares no traffic with all score alike, so they are one
    row per executor with a null ``to_slot``; every other slot has its own row.
    ``slots`` (``topology_id, slot_id``) tells which there are: without it other
    slots are taken to exist.  With ``candidates`` (executor, ``to_slot``) exactly those moves are scored.
    """
    aff = affinity(pairs, placement)
    home = home_affinity(placement.select(*EXECUTOR, "slot_id"), aff).select(
        *EXECUTOR, F.col("slot_id").alias("from_slot"), F.col("affinity").alias("__home")
    )
    there = aff.select(
        *EXECUTOR, F.col("slot_id").alias("to_slot"), F.col("affinity").alias("__there")
    )
    if candidates is not None:
        moves = candidates.select(*EXECUTOR, "to_slot").join(home, EXECUTOR)
        moves = moves.join(there, [*EXECUTOR, "to_slot"], "left")
    else:
        elsewhere = home.select(
            *EXECUTOR,
            "from_slot",
            "__home",
            F.lit(None).cast("int").alias("to_slot"),
            _zero().alias("__there"),
        )
        if slots is not None:  # none is left for an executor that talks to all of them
            peers = there.join(home.select(*EXECUTOR, "from_slot"), EXECUTOR)
            peers = peers.filter("to_slot != from_slot").groupBy(*EXECUTOR).agg(F.count(F.lit(1)).alias("__peers"))
            count = slots.groupBy("topology_id").agg(F.count_distinct("slot_id").alias("__slots"))
            known = elsewhere.join(peers, EXECUTOR, "left").join(count, "topology_id")
            left = F.col("__slots") - 1 - F.coalesce("__peers", F.lit(0))
            elsewhere = known.filter(left > 0).drop("__peers", "__slots")
        moves = home.join(there, EXECUTOR).unionByName(elsewhere)
    return moves.filter(
        F.col("to_slot").isNull() | (F.col("to_slot") != F.col("from_slot"))
    ).select(
        *EXECUTOR,
        "from_slot",
        "to_slot",
        (F.col("__home") - F.coalesce("__there", _zero())).alias("delta"),
    )


def best_move_to_empty(
    pairs: DataFrame, placement: DataFrame, slots: DataFrame, limits: DataFrame
) -> DataFrame:
    """For each empty slot the move that leaves the least cut traffic.

    An empty slot attracts nothing, so a move costs the executor's affinity to
    its present slot whichever empty slot it goes to: one pick per topology.
    Only executors that share their slot, and fit the load limit, may move.
    """
    aff = affinity(pairs, placement)
    shared = placement.groupBy(*SLOT).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    movers = (
        home_affinity(placement.select(*EXECUTOR, "load", "slot_id"), aff)
        .join(shared, SLOT, "left_semi")
        .transform(
            spread_join,
            limits.select("topology_id", "max_load"),
            ["topology_id"],
            ["begin_task", "end_task"],
            "inner",
        )
        .filter(fits_load(_zero(), F.col("load"), F.col("max_load")))
    )
    best = movers.groupBy("topology_id").agg(
        F.min(
            F.struct(
                "affinity", "begin_task", "end_task", F.col("slot_id").alias("from_slot")
            )
        ).alias("__best")
    )
    cut = slot_traffic_total(slot_traffic(pairs, placement))
    return (
        empty_slots(slots, placement)
        .join(best, "topology_id")
        .join(cut, "topology_id", "left")
        .select(
            "topology_id",
            F.col("slot_id").alias("to_slot"),
            "__best.from_slot",
            "__best.begin_task",
            "__best.end_task",
            (F.coalesce("traffic", _zero()) + F.col("__best.affinity")).alias("cut"),
        )
    )


def score_slot_moves(
    slots: DataFrame,
    slot_node: DataFrame,
    slot_loads: DataFrame,
    nodes: DataFrame,
    limits: DataFrame,
) -> DataFrame:
    """Change in inter-node traffic if a slot moves to a node its topology does not use.

    Asked for slots on nodes that hold more than one slot of the topology; each
    gets the least loaded unused node that can take it.
    """
    on_node = topology_slots_on_node(slot_node)
    crowded = on_node.filter(F.col("slots") > 1).select("node", "topology_id")
    movable = (
        slot_node.join(crowded, ["topology_id", "node"], "left_semi")
        .withColumnRenamed("node", "from_node")
        .join(slot_loads.select(*SLOT, "load"), SLOT)
    )
    asked = least_loaded_unused_node(movable, nodes, slot_node, on_node, limits)
    aff = slot_affinity(slots, slot_node)

    def pull(column: str, name: str) -> DataFrame:
        return aff.select(*SLOT, F.col("node").alias(column), F.col("affinity").alias(name))

    return (
        asked.filter(F.col("to_node").isNotNull())
        .join(pull("from_node", "__home"), [*SLOT, "from_node"], "left")
        .join(pull("to_node", "__there"), [*SLOT, "to_node"], "left")
        .select(
            *SLOT,
            "from_node",
            "to_node",
            (F.coalesce("__home", _zero()) - F.coalesce("__there", _zero())).alias("delta"),
        )
    )


def node_spread_gap(params: DataFrame, slot_node: DataFrame, node: DataFrame) -> DataFrame:
    """Topologies on fewer nodes than their ``beta`` asks for."""
    node_count = node.agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
    wanted = node_limits(params, node_count)
    gap = F.col("nodes_to_use") - F.col("node_count")
    return (
        nodes_of_topology(slot_node)
        .join(wanted, "topology_id")
        .select("topology_id", "node_count", "nodes_to_use", gap.alias("gap"))
        .filter(F.col("gap") > 0)
    )


def compare_placements(
    traffic: DataFrame, current: DataFrame, proposed: DataFrame, node: DataFrame
) -> DataFrame:
    """Two placements side by side: ``metric, node, current_value, proposed_value``.

    Both are executor tables with ``load`` and ``node``.  Cluster-wide metrics
    (inter-node traffic, number of overloaded nodes) have an empty node name.
    """

    def summary(placement: DataFrame, name: str) -> DataFrame:
        rows = [
            inter_node_traffic(traffic, placement).select(
                F.lit("inter_node_traffic").alias("metric"),
                F.lit("").alias("node"),
                F.col("traffic").alias(name),
            ),
            overloaded_nodes(placement, node)
            .agg(F.count(F.lit(1)).alias(name))
            .select(F.lit("overloaded_nodes").alias("metric"), F.lit("").alias("node"), name),
            node_load(placement, node).select(
                F.lit("node_load").alias("metric"),
                F.col("name").alias("node"),
                F.col("total_load").alias(name),
            ),
        ]
        return rows[0].unionByName(rows[1]).unionByName(rows[2])

    both = summary(current, "current_value").join(
        summary(proposed, "proposed_value"), ["metric", "node"], "full"
    )
    return both.select(
        "metric",
        "node",
        F.coalesce("current_value", _zero()).alias("current_value"),
        F.coalesce("proposed_value", _zero()).alias("proposed_value"),
    )


def relieved_nodes(current: DataFrame, proposed: DataFrame, node: DataFrame) -> DataFrame:
    """Overloaded nodes with their load in the proposed placement.

    ``absent`` marks nodes the proposed placement does not use; only a node that
    is used and carries less counts as ``relieved``.
    """
    after = (
        proposed.filter(F.col("node").isNotNull())
        .groupBy(F.col("node").alias("name"))
        .agg(F.sum("load").alias("proposed_load"))
    )
    return (
        overloaded_nodes(current, node)
        .join(after, "name", "left")
        .select(
            "name",
            "capacity",
            F.col("total_load").alias("current_load"),
            F.coalesce("proposed_load", _zero()).alias("proposed_load"),
            F.col("proposed_load").isNull().alias("absent"),
            F.coalesce(F.col("total_load") > F.col("proposed_load"), F.lit(False)).alias("relieved"),
        )
    )


def change_reasons(df: DataFrame) -> DataFrame:
    """Adds the verdict to rows with ``current_traffic, best_traffic, improvement,
    relieves_overload``.  Without a proposed placement (null) traffic is no reason."""
    threshold = P.traffic_threshold("current_traffic", "improvement")
    return df.withColumns(
        {
            "threshold": threshold,
            "due_to_traffic": F.coalesce(threshold >= F.col("best_traffic"), F.lit(False)),
            "due_to_overload": F.coalesce("relieves_overload", F.lit(False)),
        }
    ).withColumn("wanted", F.col("due_to_traffic") | F.col("due_to_overload"))


def reschedule_decision(
    traffic: DataFrame,
    current: DataFrame,
    proposed: DataFrame,
    node: DataFrame,
    improvement: int,
) -> DataFrame:
    """One row: is the proposed placement worth a change, and why."""
    relieved = relieved_nodes(current, proposed, node).agg(
        F.coalesce(F.bool_or("relieved"), F.lit(False)).alias("r")
    )
    placed = proposed.agg(F.count("node").alias("n"))
    best = inter_node_traffic(traffic, proposed)
    row = inter_node_traffic(traffic, current).select(
        F.col("traffic").alias("current_traffic"),
        F.when(placed.scalar() > 0, best.scalar()).alias("best_traffic"),
        F.lit(improvement).alias("improvement"),
        relieved.scalar().alias("relieves_overload"),
    )
    return change_reasons(row).drop("relieves_overload")
