"""Every operator as a query over the bridge views: ``QUERIES[name](spark, sf_dir)``.

Nested results are rendered as text so that any engine can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.functions import params as P
from flowscope.functions import text as X
from flowscope.operators import choose, cooldown, history, pairing, placement, resolve, rollup, series, sets, whatif
from flowscope.operators.joins import spread_join
from flowscope.plans import reports
from flowscope.plans.bridge import Bridge, evaluations_of, receipts_of, snapshot_rows
from flowscope.runtime import scratch_path
from flowscope.schema import EXECUTOR, SLOT
from flowscope.sources import cpuinfo, latest, tables
from flowscope.sources.changelog import ChangeLog
from flowscope.streaming import decisions, stats
from flowscope.streaming.sources import append_end_marker, read_files, run_to_end, with_event_time

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CLOCK_HZ = 2_000_000_000
SLOT_LENGTH = "6 hours"
SLOT_SECONDS = 6 * 3600
HISTORY = 6
IMPROVEMENT = 30
TIMEOUT_S = 12 * 3600


def query(name: str):
    def register(build: Callable[[Bridge], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Bridge(spark, sf_dir))
        return build

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest executor pairs of every topology."""
    return QUERIES["top_executor_pairs"](spark, sf_dir)


def _csv(items: str) -> Column:
    return X.list_to_csv(items)


# Sources and latest-value tables ------------------------------------------------


@query("scan_tables")
def _(b: Bridge) -> DataFrame:
    root = scratch_path(b.spark, "telemetry")
    measure = {"topology": "topology_id", "load": "load", "traffic": "traffic", "node": "capacity"}
    parts = []
    for name, column in measure.items():
        tables.write_table(getattr(b, name), name, f"{root}/{name}")
        parts.append(
            tables.read_table(b.spark, name, f"{root}/{name}", [column]).agg(
                F.count(F.lit(1)).alias("row_count"), F.sum(column).cast("long").alias("checksum")
            ).select(F.lit(name).alias("table_name"), "row_count", "checksum")
        )
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("scan_cpuinfo")
def _(b: Bridge) -> DataFrame:
    return b.cores


@query("sink_assignment_append")
def _(b: Bridge) -> DataFrame:
    changes = history.assignment_changes(b.snapshots)
    rows = history.assignment_rows(changes, b.snapshots, b.snapshot_topologies)
    path = scratch_path(b.spark, "assignment")
    tables.append_assignments(rows.withColumnRenamed("snapshot", "time"), path)
    stored = tables.read_assignments(b.spark, path)
    return stored.select(X.format_ts("time").alias("time"), "topologies", "assignment")


def _altered(df: DataFrame, value: str, keep: Column) -> DataFrame:
    """A second delivery: part of the rows with other values."""
    return df.filter(keep).withColumn(value, F.col(value) * 2 + 1)


def _compacted(b: Bridge, label: str, keys: list[str], first: DataFrame, second: DataFrame) -> DataFrame:
    """The latest values of two deliveries, the first one in the base by then, the second in the tail."""
    deliveries = [df.withColumn("version", F.lit(n)) for n, df in ((1, first), (2, second))]
    log = ChangeLog(b.spark, scratch_path(b.spark, label), deliveries[0].schema, tuple(keys), ("version",), parts=16)
    log.append(deliveries[0], "1")
    log.compact()
    log.append(deliveries[1], "2")
    return log.current()


@query("upsert_load")
def _(b: Bridge) -> DataFrame:
    later = _altered(b.load, "load", F.col("begin_task") % 3 == 0).withColumn("node", F.lit("MOVED"))
    return _compacted(b, "load-log", EXECUTOR, b.load, later)


@query("upsert_traffic")
def _(b: Bridge) -> DataFrame:
    later = _altered(b.traffic, "traffic", F.col("destination_task") % 3 == 0)
    return _compacted(b, "traffic-log", latest.TRAFFIC_KEY, b.traffic, later)


@query("upsert_node")
def _(b: Bridge) -> DataFrame:
    known = b.node.filter(F.col("name") < "NATION_2")
    first = b.nation_speed.withColumn("version", F.lit(0))
    second = first.select("name", F.col("capacity") + 100, F.col("cores") + 1, F.lit(1))
    return latest.upsert_node(known, first.union(second).union(first), ["version"])


@query("register_topology")
def _(b: Bridge) -> DataFrame:
    known = b.topology.filter(F.col("topology_id") <= 3)
    events = b.table("events").select(F.col("event_type").alias("topology_key"))
    return latest.register_topologies(known, events.unionByName(b.topology.select("topology_key")))


@query("purge_topologies")
def _(b: Bridge) -> DataFrame:
    stale = sets.stale_topologies(b.topology, b.live)
    kept = [
        (name, latest.purge(getattr(b, name), stale), measure)
        for name, measure in (("load", "load"), ("traffic", "traffic"), ("topology", "topology_id"))
    ]
    parts = [
        df.groupBy("topology_id")
        .agg(F.count(F.lit(1)).alias("row_count"), F.sum(measure).cast("long").alias("total"))
        .select(F.lit(name).alias("table_name"), "topology_id", "row_count", "total")
        for name, df, measure in kept
    ]
    return parts[0].union(parts[1]).union(parts[2])


# Filters and predicates ---------------------------------------------------------


@query("filter_topology")
def _(b: Bridge) -> DataFrame:
    return resolve.filter_topologies(b.load, b.topology, ["AUTOMOBILE", "MACHINERY"])


@query("task_in_executor")
def _(b: Bridge) -> DataFrame:
    owned = resolve.resolve_tasks(b.task_load.select("topology_id", "task"), b.load)
    beyond = owned.withColumn("next_task", F.col("task") + 1)
    return beyond.select(
        "topology_id",
        "task",
        resolve.includes("begin_task", "end_task", "task").alias("inside"),
        resolve.includes("begin_task", "end_task", "next_task").alias("next_inside"),
    )


@query("cross_placement_filter")
def _(b: Bridge) -> DataFrame:
    return rollup.cross_node_edges(b.traffic, b.load).select(
        "topology_id", "source_task", "destination_task", "src_node", "dst_node", "traffic"
    )


@query("can_accept_slot")
def _(b: Bridge) -> DataFrame:
    """May an executor join the slots it talks to?"""
    peers = whatif.affinity(b.pairs, b.placement)
    mine = b.load.select(*EXECUTOR, F.col("load").alias("x")).withColumn("k", F.lit(1))
    candidates = peers.select(*EXECUTOR, "slot_id").join(mine.hint("merge"), EXECUTOR)
    return placement.can_accept_slot(candidates, b.state)


@query("can_assign_node")
def _(b: Bridge) -> DataFrame:
    """May a slot join the nodes its peers run on?"""
    peers = whatif.slot_affinity(b.slot_pairs, b.slot_node)
    candidates = peers.select(*SLOT, "node").join(b.occupancy.select(*SLOT, "load"), SLOT)
    return placement.can_assign_node(
        candidates, b.node_state, b.slot_node, b.on_node, b.node_limits
    )


@query("empty_slots")
def _(b: Bridge) -> DataFrame:
    return placement.empty_slots(placement.declared_slots(b.params), b.placement)


@query("used_slots")
def _(b: Bridge) -> DataFrame:
    return placement.used_slots(placement.declared_slots(b.params), b.placement)


@query("validate_params")
def _(b: Bridge) -> DataFrame:
    broken = P.validate_params(P.default_params(P.parse_params(b.conf)))
    return broken.select("conf_id", _csv("broken").alias("broken"))


@query("default_params")
def _(b: Bridge) -> DataFrame:
    return P.default_params(P.parse_params(b.conf)).select(
        "conf_id",
        "alfa",
        "beta",
        F.col("gamma").isNull().alias("no_gamma"),
        "delta",
        "epsilon",
        "timeout_s",
    )


# Joins --------------------------------------------------------------------------


@query("join_load_topology")
def _(b: Bridge) -> DataFrame:
    return resolve.join_load_topology(b.load, b.topology).select(
        "topology_key", "begin_task", "end_task", "load"
    )


@query("resolve_task_executor")
def _(b: Bridge) -> DataFrame:
    """Executors of one node are missing, so some tasks stay unresolved."""
    some = b.load.filter(F.col("node") != "NATION_5")
    found = resolve.resolve_tasks(b.task_load.select("topology_id", "task"), some)
    return found.select(
        "topology_id",
        "task",
        F.coalesce(X.executor_label("begin_task", "end_task"), F.lit("none")).alias("executor"),
        F.col("begin_task").isNotNull().alias("resolved"),
    )


@query("resolve_edge_executors")
def _(b: Bridge) -> DataFrame:
    return resolve.resolve_edges(b.traffic, b.load)


@query("join_load_node")
def _(b: Bridge) -> DataFrame:
    return resolve.join_load_node(b.load, b.node)


@query("match_executor")
def _(b: Bridge) -> DataFrame:
    """Declared executors, every seventh with a range that was not measured."""
    end = F.col("end_task") + F.when(F.col("begin_task") % 7 == 0, 1).otherwise(0)
    declared = b.placement.select("topology_id", "begin_task", end.alias("end_task"), "component")
    return resolve.match_executors(b.load, declared)


@query("executor_to_slot")
def _(b: Bridge) -> DataFrame:
    placed = b.placement.filter(F.col("component") != "c2")
    found = placement.executor_to_slot(b.load.select(*EXECUTOR), placed)
    return found.withColumn("slot_id", F.coalesce("slot_id", F.lit(-1)))


@query("slot_to_node")
def _(b: Bridge) -> DataFrame:
    found = placement.slot_to_node(placement.declared_slots(b.params), b.slot_node)
    return found.withColumn("node", F.coalesce("node", F.lit("none")))


@query("containing_slots")
def _(b: Bridge) -> DataFrame:
    placed = b.placement.filter(F.col("component") != "c2")
    found = placement.containing_slots(b.pairs, placed)
    return found.select(
        "topology_id", "src_begin", "dst_begin", F.size("slots").alias("n"), _csv("slots").alias("slots")
    )


@query("containing_nodes")
def _(b: Bridge) -> DataFrame:
    placed = b.slot_node.filter(F.col("slot_id") != 2)
    found = placement.containing_nodes(b.slot_pairs, placed)
    return found.select(
        "topology_id", "slot_a", "slot_b", F.size("nodes").alias("n"), _csv("nodes").alias("nodes")
    )


@query("describe_assignment")
def _(b: Bridge) -> DataFrame:
    return placement.describe_assignment(b.placement, b.placement, b.slot_node)


@query("upstream_slots")
def _(b: Bridge) -> DataFrame:
    return placement.upstream_slots(b.dag, b.placement, b.state)


@query("ports_per_host")
def _(b: Bridge) -> DataFrame:
    return placement.ports_per_host(b.node, b.ports)


# Aggregations -------------------------------------------------------------------


@query("total_load")
def _(b: Bridge) -> DataFrame:
    """One topology has lost its rows and still reports 0."""
    gone = b.topology.filter(F.col("topology_key") == "BUILDING")
    return rollup.total_load(latest.purge(b.load, gone), b.topology)


@query("overloaded_nodes")
def _(b: Bridge) -> DataFrame:
    return rollup.overloaded_nodes(b.load, b.node)


@query("executor_traffic")
def _(b: Bridge) -> DataFrame:
    return b.derive_executor_traffic()


def _without_some(b: Bridge) -> DataFrame:
    """Loads of one topology are incomplete."""
    hole = (F.col("topology_id") == 2) & (F.col("begin_task") % 8 == 0)
    return b.load.filter(~hole)


@query("complete_topologies")
def _(b: Bridge) -> DataFrame:
    return rollup.complete_topologies(b.traffic, _without_some(b))


@query("executor_traffic_complete_only")
def _(b: Bridge) -> DataFrame:
    return rollup.executor_traffic(b.traffic, _without_some(b))


@query("inter_node_traffic")
def _(b: Bridge) -> DataFrame:
    return rollup.inter_node_traffic(b.traffic, b.load)


@query("inter_node_traffic_by_topology")
def _(b: Bridge) -> DataFrame:
    return rollup.inter_node_traffic_by_topology(b.traffic, b.load, b.topology)


@query("slot_traffic")
def _(b: Bridge) -> DataFrame:
    return b.slot_pairs


@query("node_traffic")
def _(b: Bridge) -> DataFrame:
    return rollup.node_traffic(b.slot_pairs, b.slot_node)


@query("slot_traffic_total")
def _(b: Bridge) -> DataFrame:
    return rollup.slot_traffic_total(b.slot_pairs)


@query("node_traffic_total")
def _(b: Bridge) -> DataFrame:
    nodes = rollup.node_traffic(b.slot_pairs, b.slot_node)
    return rollup.node_traffic_total(nodes, b.slot_node)


@query("executor_ranges")
def _(b: Bridge) -> DataFrame:
    return rollup.executor_ranges(b.thread_tasks)


@query("adjacency")
def _(b: Bridge) -> DataFrame:
    """Incident edges of executors and of slots, in pages."""
    edge = F.transform(
        "edges",
        lambda e: F.format_string("%d>%d:%d", e["src_begin"], e["dst_begin"], e["traffic"]),
    )
    executors = rollup.executor_adjacency(b.pairs).select(
        F.lit("executor").alias("kind"),
        "topology_id",
        F.col("begin_task").alias("member"),
        "page",
        "degree",
        "traffic",
        F.array_join(edge, " ").alias("edges"),
    )
    slot_edge = F.transform(
        "edges", lambda e: F.format_string("%d-%d:%d", e["slot_a"], e["slot_b"], e["traffic"])
    )
    slots = rollup.slot_adjacency(b.slot_pairs).select(
        F.lit("slot").alias("kind"),
        "topology_id",
        F.col("slot_id").alias("member"),
        "page",
        "degree",
        "traffic",
        F.array_join(slot_edge, " ").alias("edges"),
    )
    return executors.unionByName(slots)


@query("slot_occupancy")
def _(b: Bridge) -> DataFrame:
    return b.occupancy


@query("node_occupancy")
def _(b: Bridge) -> DataFrame:
    return b.node_state


@query("topology_slots_on_node")
def _(b: Bridge) -> DataFrame:
    return b.on_node


@query("nodes_of_topology")
def _(b: Bridge) -> DataFrame:
    found = rollup.nodes_of_topology(b.slot_node)
    return found.select("topology_id", "node_count", _csv("nodes").alias("nodes"))


@query("slots_of_node")
def _(b: Bridge) -> DataFrame:
    found = rollup.slots_of_node(b.slot_node)
    names = F.transform("slots", lambda s: F.format_string("%d/%d", s["topology_id"], s["slot_id"]))
    return found.select("node", "slot_count", X.list_to_csv(names).alias("slots"))


@query("host_cpu_totals")
def _(b: Bridge) -> DataFrame:
    return cpuinfo.host_cpu_totals(b.cores)


def _cycles(b: Bridge) -> DataFrame:
    return series.counter_delta(b.cpu, CLOCK_HZ)


@query("host_usage_pct")
def _(b: Bridge) -> DataFrame:
    hosts = cpuinfo.host_cpu_totals(b.cores)
    return series.host_usage_pct(_cycles(b), b.thread_hosts, hosts, 2)


@query("assignment_map")
def _(b: Bridge) -> DataFrame:
    folded = history.assignment_map(b.snapshots)
    return folded.select("snapshot", "host", X.map_to_text("slots").alias("slots")).withColumn(
        "snapshot", F.date_format("snapshot", "yyyy-MM-dd")
    )


def _counts(b: Bridge) -> DataFrame:
    return series.tuple_counts(b.receipts, SLOT_LENGTH)


@query("tuple_counts")
def _(b: Bridge) -> DataFrame:
    return _counts(b).withColumn("slot_start", X.format_ts("slot_start"))


# Series -------------------------------------------------------------------------


@query("counter_delta")
def _(b: Bridge) -> DataFrame:
    return _cycles(b).select("thread_id", "event_id", "cpu_total", "cycles")


@query("moving_rate")
def _(b: Bridge) -> DataFrame:
    """Traffic per topology and source, and load per thread: one operator for both."""
    sent = series.tuple_counts(b.receipts, SLOT_LENGTH, keys=["source_task"])
    traffic = series.moving_rate(
        sent.withColumn("tuples", F.col("tuples") * SLOT_SECONDS),
        ["topology_key", "source_task"],
        ["slot_start"],
        "tuples",
        HISTORY,
        3600,
    )
    load = series.moving_rate(
        _cycles(b), ["thread_id"], ["ts", "event_id"], "cycles", HISTORY, 7
    )
    return traffic.select(
        F.col("topology_key").alias("series"),
        F.col("source_task").cast("long").alias("member"),
        X.format_ts("slot_start").alias("at"),
        F.lit(0).cast("long").alias("event_id"),
        "rate",
    ).unionByName(
        load.select(
            F.lit("load").alias("series"),
            F.col("thread_id").alias("member"),
            X.format_ts("ts").alias("at"),
            "event_id",
            "rate",
        )
    )


@query("latest_sample")
def _(b: Bridge) -> DataFrame:
    return series.latest_sample(
        _cycles(b), ["thread_id"], ["ts", "event_id"], ["cpu_total", "cycles"]
    )


@query("rank_executor_traffic")
def _(b: Bridge) -> DataFrame:
    return choose.rank_executor_traffic(b.derive_executor_traffic())


@query("min_nodes_needed")
def _(b: Bridge) -> DataFrame:
    return choose.min_nodes_needed(b.ports, 4, 0.5)


@query("round_robin_deal")
def _(b: Bridge) -> DataFrame:
    return choose.round_robin_deal(b.ports, 4, 0.5)


@query("assignment_changes")
def _(b: Bridge) -> DataFrame:
    changed = history.assignment_changes(b.snapshots)
    return changed.select(F.date_format("snapshot", "yyyy-MM-dd").alias("snapshot"))


# Ranking and picking --------------------------------------------------------------


@query("top_executor_pairs")
def _(b: Bridge) -> DataFrame:
    return choose.top_executor_pairs(b.derive_executor_traffic(), 10)


@query("slot_pairs_ranked")
def _(b: Bridge) -> DataFrame:
    return choose.slot_pairs_ranked(b.slot_pairs)


def _loaded_pairs(b: Bridge) -> DataFrame:
    def side(prefix: str) -> DataFrame:
        return b.load.select(
            "topology_id",
            F.col("begin_task").alias(f"{prefix}_begin"),
            F.col("end_task").alias(f"{prefix}_end"),
            F.col("load").alias(f"{prefix}_load"),
        )

    src, dst = ["src_begin", "src_end"], ["dst_begin", "dst_end"]
    at_source = spread_join(b.pairs, side("src"), ["topology_id", *src], dst, "inner", grows=True)
    return spread_join(at_source, side("dst"), ["topology_id", *dst], src, "inner", grows=True)


@query("least_loaded_slot")
def _(b: Bridge) -> DataFrame:
    """The three requests a pair can make: its source, both, or the heavier one."""
    one, two = F.lit(1), F.lit(2)
    asked = _loaded_pairs(b).withColumn(
        "form",
        F.explode(
            F.array(
                F.struct(F.lit("source").alias("f"), one.alias("k"), F.col("src_load").alias("x")),
                F.struct(
                    F.lit("both").alias("f"),
                    two.alias("k"),
                    (F.col("src_load") + F.col("dst_load")).alias("x"),
                ),
                F.struct(
                    F.lit("heavier").alias("f"),
                    one.alias("k"),
                    F.greatest("src_load", "dst_load").alias("x"),
                ),
            )
        ),
    ).select("topology_id", "src_begin", "dst_begin", "form.*")
    picked = choose.least_loaded_slot(asked, b.state)
    return picked.select(
        "topology_id",
        "src_begin",
        "dst_begin",
        F.col("f").alias("form"),
        F.coalesce("slot_id", F.lit(-1)).alias("slot_id"),
    )


@query("least_loaded_node")
def _(b: Bridge) -> DataFrame:
    """One slot, both slots of a pair, the heavier one, and one slot on an unused node."""
    sizes = b.occupancy.select(*SLOT, "load")
    on_pairs = b.slot_pairs.join(
        sizes.withColumnsRenamed({"slot_id": "slot_a", "load": "load_a"}), ["topology_id", "slot_a"]
    ).join(
        sizes.withColumnsRenamed({"slot_id": "slot_b", "load": "load_b"}), ["topology_id", "slot_b"]
    )
    single = sizes.select(
        "topology_id",
        F.lit("one").alias("form"),
        F.col("slot_id").alias("slot_a"),
        F.col("slot_id").alias("slot_b"),
        F.lit(1).alias("k"),
        F.col("load").alias("x"),
    )
    both = on_pairs.select(
        "topology_id",
        F.lit("both").alias("form"),
        "slot_a",
        "slot_b",
        F.lit(2).alias("k"),
        (F.col("load_a") + F.col("load_b")).alias("x"),
    )
    heavier = on_pairs.select(
        "topology_id",
        F.lit("heavier").alias("form"),
        "slot_a",
        "slot_b",
        F.lit(1).alias("k"),
        F.greatest("load_a", "load_b").alias("x"),
    )
    asked = single.unionByName(both).unionByName(heavier)
    picked = choose.least_loaded_node(asked, b.node_state, b.on_node, b.node_limits)
    unused = choose.least_loaded_unused_node(
        sizes, b.node_state, b.slot_node, b.on_node, b.node_limits
    ).select(
        "topology_id",
        F.lit("unused").alias("form"),
        F.col("slot_id").alias("slot_a"),
        F.col("slot_id").alias("slot_b"),
        F.col("to_node").alias("node"),
    )
    columns = ["topology_id", "form", "slot_a", "slot_b", "node"]
    return (
        picked.select(*columns)
        .unionByName(unused)
        .withColumn("node", F.coalesce("node", F.lit("none")))
    )


@query("hosts_by_free_ports")
def _(b: Bridge) -> DataFrame:
    return choose.hosts_by_free_ports(b.ports)


# Sets ---------------------------------------------------------------------------


@query("stale_topologies")
def _(b: Bridge) -> DataFrame:
    return sets.stale_topologies(b.topology, b.live)


@query("active_topologies")
def _(b: Bridge) -> DataFrame:
    return sets.active_topologies(b.topology, b.live)


@query("union_ports")
def _(b: Bridge) -> DataFrame:
    return placement.union_ports(b.ports)


@query("unused_nodes")
def _(b: Bridge) -> DataFrame:
    return placement.unused_nodes(b.topology, b.node, b.slot_node)


# Scalar functions -----------------------------------------------------------------


@query("max_executors_per_slot")
def _(b: Bridge) -> DataFrame:
    return placement.slot_limits(b.params).select("topology_id", "slot_count", "max_executors")


@query("nodes_to_use")
def _(b: Bridge) -> DataFrame:
    return b.node_limits.select("topology_id", "nodes_to_use")


@query("max_slots_per_node")
def _(b: Bridge) -> DataFrame:
    return b.node_limits.select("topology_id", "max_slots")


@query("max_load_per_slot")
def _(b: Bridge) -> DataFrame:
    return placement.slot_limits(b.params).select("topology_id", "max_load")


@query("param_limits")
def _(b: Bridge) -> DataFrame:
    """All derived limits over the parsed parameter sets, with sizes from the set's id."""
    key = F.col("conf_id")
    sized = P.default_params(P.parse_params(b.conf)).withColumns(
        {
            "executors": (key % 37 + 1).cast("int"),
            "slots": P.slot_count((key % 11 + 1).cast("int"), (key % 37 + 1).cast("int")),
            "nodes": (key % 9 + 1).cast("int"),
        }
    )
    return sized.select(
        "conf_id",
        P.max_executors_per_slot("executors", "slots", "alfa").alias("max_executors"),
        P.nodes_to_use("nodes", "slots", "beta").alias("nodes_to_use"),
        P.max_slots_per_node("nodes", "slots", "beta", "delta").alias("max_slots"),
        F.coalesce(P.max_load_per_slot(key * 1_000_003, "slots", "gamma"), F.lit(-1)).alias("max_load"),
    )


@query("absolute_capacity")
def _(b: Bridge) -> DataFrame:
    hosts = cpuinfo.host_cpu_totals(b.cores)
    return hosts.select("host", P.absolute_capacity("total_hz", F.lit(80)).alias("capacity"))


@query("mhz_to_hz")
def _(b: Bridge) -> DataFrame:
    part = b.table("part").select("p_partkey", F.round("p_retailprice", 2).alias("mhz"))
    return part.select("p_partkey", P.mhz_to_hz(F.col("mhz").cast("string")).alias("hz"))


@query("traffic_threshold")
def _(b: Bridge) -> DataFrame:
    return b.evaluations.select(
        "event_id",
        P.traffic_threshold("current_traffic", (F.col("event_id") % 100 + 1).cast("int")).alias(
            "threshold"
        ),
    )


@query("list_to_csv")
def _(b: Bridge) -> DataFrame:
    """Lists of 0 to 3 items and missing ones, alone and in a map."""
    key = F.col("s_suppkey")
    items = F.when(key % 5 != 0, F.slice(F.array(key, key + 1, key + 2), 1, (key % 4).cast("int")))
    mapped = F.when(
        key % 7 == 0, F.create_map().cast("map<string,array<bigint>>")
    ).when(key % 7 != 1, F.create_map(F.lit("b"), items, F.lit("a"), F.array(key)))
    return b.table("supplier").select(
        "s_suppkey", X.list_to_csv(items).alias("items"), X.map_to_text(mapped).alias("mapped")
    )


@query("serialize_assignment")
def _(b: Bridge) -> DataFrame:
    return history.serialize_assignment(b.snapshots).withColumn(
        "snapshot", F.date_format("snapshot", "yyyy-MM-dd")
    )


@query("format_ts")
def _(b: Bridge) -> DataFrame:
    return b.table("events").select("event_id", X.format_ts("ts").alias("at"))


@query("split_key_value")
def _(b: Bridge) -> DataFrame:
    lines = b.cpuinfo.select("host", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    kept = lines.filter(F.col("line") != "")
    return kept.select(
        "host", "line_no", X.key_of("line").alias("key"), X.value_of("line").alias("value")
    )


@query("edge_labels")
def _(b: Bridge) -> DataFrame:
    tasks = b.traffic.select(
        F.lit("task").alias("kind"), "topology_id", X.task_pair_label("source_task", "destination_task").alias("label")
    )
    executors = b.pairs.select(
        F.lit("executor").alias("kind"),
        "topology_id",
        X.executor_pair_label("src_begin", "src_end", "dst_begin", "dst_end", "traffic").alias("label"),
    )
    slots = b.slot_pairs.select(
        F.lit("slot").alias("kind"),
        "topology_id",
        X.slot_pair_label("slot_a", "slot_b", "traffic").alias("label"),
    )
    return tasks.unionByName(executors).unionByName(slots)


# What if --------------------------------------------------------------------------


@query("affinity")
def _(b: Bridge) -> DataFrame:
    return whatif.affinity(b.pairs, b.placement)


@query("slot_affinity")
def _(b: Bridge) -> DataFrame:
    return whatif.slot_affinity(b.slot_pairs, b.slot_node)


@query("score_moves")
def _(b: Bridge) -> DataFrame:
    """``to_slot`` -1 stands for every slot the executor shares no traffic with."""
    moves = whatif.score_moves(b.pairs, b.placement, slots=b.state)
    return moves.withColumn("to_slot", F.coalesce("to_slot", F.lit(-1)))


@query("score_pair_placements")
def _(b: Bridge) -> DataFrame:
    return pairing.score_pair_placements(b.pairs, b.part_placement, b.part_state)


@query("best_move_to_empty")
def _(b: Bridge) -> DataFrame:
    return whatif.best_move_to_empty(
        b.pairs, b.placement, placement.declared_slots(b.params), placement.slot_limits(b.params)
    )


@query("best_pair_placement")
def _(b: Bridge) -> DataFrame:
    return pairing.best_pair_placement(b.pairs, b.part_placement, b.part_state)


@query("score_slot_moves")
def _(b: Bridge) -> DataFrame:
    return whatif.score_slot_moves(
        b.slot_pairs, b.slot_node, b.occupancy, b.node_state, b.node_limits
    )


@query("score_slot_pair_placements")
def _(b: Bridge) -> DataFrame:
    return pairing.score_slot_pair_placements(
        b.slot_pairs, b.part_slot_node, b.occupancy, b.part_node_state, b.node_limits
    )


@query("node_spread_gap")
def _(b: Bridge) -> DataFrame:
    return whatif.node_spread_gap(b.params, b.slot_node, b.node)


@query("compare_placements")
def _(b: Bridge) -> DataFrame:
    return whatif.compare_placements(b.traffic, b.load, b.proposed, b.node)


@query("relieved_nodes")
def _(b: Bridge) -> DataFrame:
    return whatif.relieved_nodes(b.load, b.proposed, b.node)


@query("reschedule_decision")
def _(b: Bridge) -> DataFrame:
    return whatif.reschedule_decision(b.traffic, b.load, b.proposed, b.node, IMPROVEMENT)


def _judged(evaluations: DataFrame) -> DataFrame:
    rows = evaluations.withColumns(
        {"improvement": F.lit(IMPROVEMENT), "timeout_s": F.lit(TIMEOUT_S)}
    )
    return whatif.change_reasons(rows)


@query("cooldown_alerts")
def _(b: Bridge) -> DataFrame:
    fired = cooldown.cooldown_alerts(_judged(b.evaluations))
    return fired.select("topology_key", "event_id", X.format_ts("eval_ts").alias("eval_ts"))


# Reports --------------------------------------------------------------------------


@query("monitoring_cycle")
def _(b: Bridge) -> DataFrame:
    topology = b.receipts.select("topology_key").distinct()
    numbered = latest.register_topologies(b.topology, topology)
    scaled = b.receipts.withColumn("destination_task", F.col("destination_task") % 5)
    return reports.monitoring_cycle(scaled, numbered, "1 day", HISTORY, 1)


@query("load_cycle")
def _(b: Bridge) -> DataFrame:
    return reports.load_cycle(b.cpu, b.thread_tasks, CLOCK_HZ, HISTORY, 7)


@query("evaluation_summary")
def _(b: Bridge) -> DataFrame:
    return reports.evaluation_summary(
        b.topology, b.live, b.traffic, b.load, b.placement, b.slot_node, b.node, b.params
    )


@query("tracked_assignment")
def _(b: Bridge) -> DataFrame:
    return reports.tracked_assignment(b.placement, b.placement, b.slot_node, b.topology)


# Streams --------------------------------------------------------------------------
#
# Each query runs its stream to the present end of a file source and reads the
# sink back.  Where windows are to close, the source ends with a marker.

DELAY = "1 hour"


def _event_stream(b: Bridge) -> DataFrame:
    schema = b.table("events").schema
    return with_event_time(read_files(b.spark, b.sf_dir, schema, pattern="events.parquet"))


def _ended_events(b: Bridge, slot_length: str) -> DataFrame:
    """The events in a folder of their own, ended after the last slot."""
    events = b.table("events")
    path = f"{scratch_path(b.spark, 'events')}/in"
    events.write.parquet(path)
    last = events.agg(F.max("ts")).first()[0]
    if last is not None:
        append_end_marker(b.spark, path, events.schema, last, slot_length, DELAY)
    return with_event_time(read_files(b.spark, path, events.schema))


def _landed(b: Bridge, stream: DataFrame, label: str) -> tuple[DataFrame, str]:
    root = scratch_path(b.spark, label)
    run_to_end(stream, f"{root}/out", f"{root}/checkpoint")
    return b.spark.read.schema(stream.schema).parquet(f"{root}/out"), f"{root}/out"


def _relay(b: Bridge, stream: DataFrame, label: str) -> DataFrame:
    """Lands a stream in a table and streams on from there."""
    _, path = _landed(b, stream, label)
    return read_files(b.spark, path, stream.schema)


@query("stream_receipts")
def _(b: Bridge) -> DataFrame:
    landed, _ = _landed(b, receipts_of(_event_stream(b)), "receipts")
    return landed.withColumn("ts", X.format_ts("ts"))


def _stream_counts(b: Bridge) -> DataFrame:
    return stats.stream_tuple_counts(receipts_of(_ended_events(b, SLOT_LENGTH)), SLOT_LENGTH, DELAY)


def _stream_rates(b: Bridge) -> DataFrame:
    counts = _relay(b, _stream_counts(b), "slot-counts")
    scaled = counts.withColumn("tuples", F.col("tuples") * SLOT_SECONDS)
    return stats.stream_moving_rate(scaled, HISTORY, 5000)


@query("stream_tuple_counts")
def _(b: Bridge) -> DataFrame:
    landed, _ = _landed(b, _stream_counts(b), "slot-counts")
    return landed.withColumn("slot_start", X.format_ts("slot_start"))


@query("stream_moving_rate")
def _(b: Bridge) -> DataFrame:
    landed, _ = _landed(b, _stream_rates(b), "rates")
    return landed.withColumn("slot_start", X.format_ts("slot_start"))


@query("stream_counter_delta")
def _(b: Bridge) -> DataFrame:
    root = scratch_path(b.spark, "counters")
    samples = with_event_time(b.cpu)
    samples.write.parquet(f"{root}/samples")
    source = read_files(b.spark, f"{root}/samples", samples.schema)
    landed, _ = _landed(b, stats.stream_counter_delta(source, CLOCK_HZ), "cycles")
    return landed.select("thread_id", "event_id", "cpu_total", "cycles")


@query("stream_upsert_stats")
def _(b: Bridge) -> DataFrame:
    root = scratch_path(b.spark, "stats")
    rates = _stream_rates(b).filter("rate is not null")  # late samples have none
    log = ChangeLog(b.spark, f"{root}/log", rates.schema, tuple(stats.PAIR), ("slot_start",), parts=16)
    stats.store_changes(rates, log, f"{root}/checkpoint", compact_every=1).awaitTermination()
    return log.current()


@query("stream_cooldown_alerts")
def _(b: Bridge) -> DataFrame:
    judged = _judged(evaluations_of(_event_stream(b)))
    landed, _ = _landed(b, decisions.stream_cooldown_alerts(judged), "alerts")
    return landed.withColumn("eval_ts", X.format_ts("eval_ts"))


@query("stream_assignment_changes")
def _(b: Bridge) -> DataFrame:
    rows = snapshot_rows(_ended_events(b, "1 day")).withColumn("cluster", F.lit("main"))
    marks = _relay(b, decisions.stream_fingerprints(rows, "1 day", DELAY), "fingerprints")
    landed, _ = _landed(b, decisions.stream_assignment_changes(marks, "1 day"), "changes")
    return landed.select(F.date_format("snapshot", "yyyy-MM-dd").alias("snapshot"))
