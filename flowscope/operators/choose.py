"""Ranking, top-k and picking the least loaded feasible slot or node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowscope.operators.joins import spread_join
from flowscope.operators.numbering import hierarchical_rank, pair_dimensions
from flowscope.operators.placement import fits_load

BLOCK = 4096
SPREAD = 64


def rank_executor_traffic(pairs: DataFrame) -> DataFrame:
    """Position of each pair within its topology, heaviest first, ties by ids.

    Among equally heavy pairs of one source, destinations are cut into blocks
    of ids, so that a hub of light edges is no single group either.
    """
    keyed = pairs.withColumns(
        {
            "__src": F.struct("src_begin", "src_end"),
            "__block": F.call_function("div", F.col("dst_begin"), F.lit(BLOCK)),
        }
    )
    ranked = hierarchical_rank(
        keyed,
        ["topology_id"],
        [("traffic", False), ("__src", True), ("__block", True)],
        ["dst_begin", "dst_end"],
    )
    return ranked.drop("__src", "__block")


def top_executor_pairs(pairs: DataFrame, k: int | None = None) -> DataFrame:
    """The ``k`` heaviest pairs of every topology; all of them without ``k``.

    A topology is spread over ``SPREAD`` parts by its sources.  What is not among the ``k``
    heaviest of its part is dropped there, and the rest is ranked: one plan for every
    ``k``, and no task holds more of a topology than a part.
    """
    if k is None:
        return rank_executor_traffic(pairs)
    order = [F.desc("traffic"), "src_begin", "src_end", "dst_begin", "dst_end"]
    part = F.pmod(F.xxhash64("src_begin", "dst_begin"), F.lit(SPREAD)).alias("__part")
    window = Window.partitionBy("topology_id", "__part").orderBy(*order)
    near = pairs.select("*", part).withColumn("__place", F.row_number().over(window))
    near = near.filter(F.col("__place") <= k).drop("__place", "__part")
    ranked = rank_executor_traffic(near).filter(F.col("position") <= k)
    return ranked.withColumn("position", F.col("position").cast("int"))


def slot_pairs_ranked(slots: DataFrame) -> DataFrame:
    """Slot pairs of all topologies in one order, heaviest first, with ``position``."""
    ranked = hierarchical_rank(
        slots, [], [("traffic", False), ("topology_id", True)], ["slot_a", "slot_b"]
    )
    return ranked.orderBy("position")


def free_ports_by_host(ports: DataFrame) -> DataFrame:
    return (
        ports.filter(~F.col("used"))
        .select("name", "port")
        .distinct()
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("free_ports"))
    )


def hosts_by_free_ports(ports: DataFrame) -> DataFrame:
    """Hosts with free ports, most first, ties by name, with ``position``."""
    ranked = hierarchical_rank(free_ports_by_host(ports), [], [("free_ports", False)], ["name"])
    return ranked.orderBy("position")


def min_nodes_needed(ports: DataFrame, slots: int, beta: float = 1.0) -> DataFrame:
    """Fewest hosts whose free ports hold ``slots``, and how many to use.

    Hosts with equally many free ports are interchangeable, so the running sum
    is over distinct port counts.  One row; no row if the ports do not suffice.
    """
    by_count = (
        free_ports_by_host(ports).groupBy("free_ports").agg(F.count(F.lit(1)).alias("hosts"))
    )
    before = Window.orderBy(F.desc("free_ports")).rowsBetween(Window.unboundedPreceding, -1)
    running = by_count.withColumns(
        {
            "__ports": F.coalesce(
                F.sum(F.col("free_ports") * F.col("hosts")).over(before), F.lit(0)
            ),
            "__hosts": F.coalesce(F.sum("hosts").over(before), F.lit(0)),
        }
    )
    missing = F.lit(slots) - F.col("__ports")
    here = F.ceil(missing / F.col("free_ports")).cast("long")
    nodes = by_count.agg(F.sum("hosts").alias("__all"))
    lo = F.col("min_nodes")
    hi = F.least(F.col("__all"), F.lit(slots))
    spread = F.lit(float(beta)).cast("float") * (hi - lo).cast("float")
    return (
        running.filter((F.col("__ports") < slots) & (here <= F.col("hosts")))
        .select((F.col("__hosts") + here).cast("int").alias("min_nodes"))
        .withColumn("__all", nodes.scalar())
        .select(
            "min_nodes",
            hi.cast("int").alias("max_nodes"),
            (lo + F.ceil(spread)).cast("int").alias("use_nodes"),
        )
    )


def round_robin_deal(ports: DataFrame, slots: int, beta: float = 1.0) -> DataFrame:
    """Deal ``slots`` slots over the chosen hosts in turn: ``slot, name, port``.

    Hosts are taken in order of free ports, so those with an r-th port come
    first in every round r: the position is the ports of earlier rounds plus
    the rank of the host.
    """
    use = min_nodes_needed(ports, slots, beta).select("use_nodes")
    chosen = hierarchical_rank(
        free_ports_by_host(ports), [], [("free_ports", False)], ["name"], "host_rank"
    ).filter(F.col("host_rank") <= use.scalar())
    within = Window.partitionBy("name").orderBy("port")
    dealt = (
        ports.filter(~F.col("used"))
        .select("name", "port")
        .distinct()
        .join(chosen.select("name", "host_rank"), "name")
        .withColumn("round", F.row_number().over(within))
    )
    rounds = dealt.groupBy("round").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rounds.select("round", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    position = F.col("__before") + F.col("host_rank") - 1
    return (
        dealt.join(offsets, "round")
        .select(position.cast("int").alias("slot"), "name", "port")
        .filter(F.col("slot") < slots)
    )


def least_loaded_slot(
    requests: DataFrame, state: DataFrame, k: str = "k", extra: str = "x", name: str = "slot_id"
) -> DataFrame:
    """The least loaded slot of the topology that takes ``k`` more executors and ``x`` load.

    The load limit is one per topology, so if the least loaded slot with enough
    places breaks it, every other one does too.  The pick therefore depends on
    (topology, k) alone: it is made once per distinct request size and joined,
    and requests never meet slots pairwise.
    """
    places = (F.col("max_executors") - F.col("executors")).cast("long")
    # With the limit inside the struct the equi join below brings it along.
    best = F.min(F.struct("load", "slot_id", "max_load"))
    levels = state.groupBy("topology_id", places.alias("__places")).agg(best.alias("__best"))
    sizes = requests.select("topology_id", F.col(k).cast("long").alias("__places")).distinct()
    both = levels.withColumn("__ask", F.lit(0)).unionByName(
        sizes.withColumn("__ask", F.lit(1)), allowMissingColumns=True
    )
    roomy_first = (
        Window.partitionBy("topology_id")
        .orderBy(F.desc("__places"), "__ask")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    picks = (
        both.withColumn("__slot", F.min("__best").over(roomy_first))
        .filter(F.col("__ask") == 1)
        .select("topology_id", "__places", "__slot")
    )
    fits = fits_load(F.col("__slot.load"), F.col(extra), F.col("__slot.max_load"))
    return (
        spread_join(
            requests.withColumn("__places", F.col(k).cast("long")),
            picks,
            ["topology_id", "__places"],
            [c for c in requests.columns if c != "topology_id"],
        )
        .withColumn(name, F.when(fits, F.col("__slot.slot_id")))
        .drop("__places", "__slot")
    )


def node_steps(
    asks: DataFrame, nodes: DataFrame, on_node: DataFrame, limits: DataFrame, exclude: DataFrame | None = None
) -> DataFrame:
    """Per (topology, ``__k`` slots) of ``asks`` the suitable nodes as a staircase, ``__steps``.

    Sorted by spare capacity, a node starts a step only if it is among the two least loaded of
    those with no less spare capacity: ``spare``, ``best`` and ``next`` (load, node, capacity and
    the slots there is room for).  ``exclude`` lists (topology, node) pairs that must not be used.
    """
    able = nodes.select(
        F.col("name").alias("node"),
        F.col("load").alias("__load"),
        F.col("capacity").alias("__capacity"),
        (F.col("capacity") - F.col("load")).alias("__spare"),
        F.col("free_ports").alias("__free"),
    ).filter((F.col("__free") > 0) & (F.col("__spare") >= 0))
    every = pair_dimensions(asks.join(limits.select("topology_id", "max_slots"), "topology_id"), able, "node")
    if exclude is not None:
        every = every.join(exclude, ["topology_id", "node"], "left_anti")
    here = on_node.select("topology_id", "node", F.col("slots").alias("__here"))
    left = F.least("__free", F.col("max_slots") - F.coalesce("__here", F.lit(0)))
    suitable = (
        every.join(here, ["topology_id", "node"], "left").withColumn("__room", left).filter(F.col("__room") >= F.col("__k"))
    )
    rank = F.struct(
        F.col("__load").alias("load"), "node", F.col("__capacity").alias("capacity"), F.col("__room").alias("room")
    )
    by_spare = Window.partitionBy("topology_id", "__k").orderBy(F.desc("__spare"))
    ahead = (
        Window.partitionBy("topology_id", "__k")
        .orderBy(F.desc("__spare"), "__rank")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # The second least of what came so far is the least of each one and the best before it,
    # whichever is greater.
    before = F.min("__rank").over(ahead)
    return (
        suitable.withColumn("__rank", rank)
        .withColumn("__later", F.when(before.isNotNull(), F.greatest("__rank", before)))
        .withColumns({"best": F.min("__rank").over(by_spare), "next": F.min("__later").over(by_spare)})
        .filter((F.col("__rank") == F.col("best")) | (F.col("__rank") == F.col("next")))
        .groupBy("topology_id", "__k")
        .agg(F.array_sort(F.collect_set(F.struct(F.col("__spare").alias("spare"), "best", "next"))).alias("__steps"))
    )


def step_for(steps: str, load: Column) -> Column:
    """The step of a staircase that has room for ``load``: its ``best`` is the least loaded node that takes it."""
    return F.get(F.filter(steps, lambda s: s["spare"] >= load), F.lit(0))


def least_loaded_node(
    requests: DataFrame,
    nodes: DataFrame,
    on_node: DataFrame,
    limits: DataFrame,
    exclude: DataFrame | None = None,
    k: str = "k",
    extra: str = "x",
    name: str = "node",
) -> DataFrame:
    """The least loaded node that takes ``k`` slots with ``x`` load of a topology.

    The suitable nodes are reduced to a staircase per (topology, k), see ``node_steps``.  A request
    takes the first step that is high enough, so requests never meet nodes pairwise.
    """
    asks = requests.select("topology_id", F.col(k).alias("__k")).distinct()
    steps = node_steps(asks, nodes, on_node, limits, exclude)
    return (
        spread_join(
            requests.withColumn("__k", F.col(k)),
            steps,
            ["topology_id", "__k"],
            [c for c in requests.columns if c != "topology_id"],
        )
        .withColumn(name, step_for("__steps", F.col(extra))["best"]["node"])
        .drop("__k", "__steps")
    )


def least_loaded_unused_node(
    slots: DataFrame, nodes: DataFrame, slot_node: DataFrame, on_node: DataFrame, limits: DataFrame
) -> DataFrame:
    """For each (topology, slot, load): the least loaded node without slots of the topology."""
    used = slot_node.select("topology_id", "node").distinct()
    asked = slots.withColumns({"__one": F.lit(1), "__x": F.col("load")})
    return least_loaded_node(
        asked, nodes, on_node, limits, exclude=used, k="__one", extra="__x", name="to_node"
    ).drop("__one", "__x")
