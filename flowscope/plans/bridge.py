"""Telemetry derived from the sample star schema.

A supplier is a source task, a customer (id + 100000) a destination task, a
market segment a topology and a nation a node; ``events`` give receipts,
counters, snapshots and evaluations.  The stored telemetry tables (topology,
traffic, load) are written once per application; everything else is lazy.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.functions.params import absolute_capacity
from flowscope.operators.numbering import number_keys
from flowscope.operators.placement import (
    declared_slots,
    node_limits,
    ports_per_host,
    slot_limits,
    slot_state,
)
from flowscope.operators.rollup import (
    executor_nodes,
    executor_traffic,
    node_occupancy,
    slot_occupancy,
    slot_traffic,
    topology_slots_on_node,
)
from flowscope.operators.series import day_of, running_sum
from flowscope.runtime import stored
from flowscope.sources.cpuinfo import host_cpu_totals, parse_cpuinfo

CUSTOMER_OFFSET = 100_000


def _div(a, b) -> Column:
    return F.call_function("div", a if not isinstance(a, str) else F.col(a), F.lit(b))


class Bridge:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _stored(self, name: str, build) -> DataFrame:
        return stored(self.spark, f"{self.sf_dir}:{name}", build)

    # Stored telemetry tables -------------------------------------------------

    @cached_property
    def topology(self) -> DataFrame:
        return self._stored("topology", self.derive_topology)

    @cached_property
    def _pairs(self) -> DataFrame:
        return self._stored("pairs", self.derive_pairs)

    @cached_property
    def load(self) -> DataFrame:
        return self._stored("load", self.derive_load)

    def derive_topology(self) -> DataFrame:
        keys = self.table("customer").select(F.col("c_mktsegment").alias("topology_key"))
        return number_keys(keys, "topology_key").select(
            F.col("id").alias("topology_id"), "topology_key"
        )

    @cached_property
    def live(self) -> DataFrame:
        keys = self.table("customer").select(F.col("c_mktsegment").alias("topology_key"))
        return keys.filter(F.col("topology_key") != "BUILDING").distinct()

    def derive_pairs(self) -> DataFrame:
        """Lines and quantity per (supplier, customer), summed before the customer join."""
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        sums = (
            lines.join(orders, lines.l_orderkey == orders.o_orderkey)
            .groupBy("l_suppkey", "o_custkey")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
        )
        customer = self.table("customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("topology_key")
        )
        return sums.join(customer.join(self.topology, "topology_key"), "o_custkey").select(
            "topology_id",
            F.col("l_suppkey").cast("int").alias("source_task"),
            (F.col("o_custkey") + CUSTOMER_OFFSET).cast("int").alias("destination_task"),
            "n",
            "q",
        )

    @cached_property
    def traffic(self) -> DataFrame:
        return self._pairs.select(
            "topology_id", "source_task", "destination_task", F.col("n").cast("int").alias("traffic")
        )

    @cached_property
    def task_load(self) -> DataFrame:
        sides = [
            self._pairs.groupBy("topology_id", F.col(c).alias("task")).agg(F.sum("q").alias("q"))
            for c in ("source_task", "destination_task")
        ]
        return sides[0].unionByName(sides[1]).withColumn("q", F.col("q").cast("long"))

    def derive_load(self) -> DataFrame:
        block = F.when(F.col("task") < CUSTOMER_OFFSET, _div("task", 4)).otherwise(
            F.lit(1_000_000) + _div("task", 50)
        )
        nation = self.table("nation").select(
            F.col("n_nationkey").cast("long").alias("__nation"), F.col("n_name").alias("node")
        )
        return (
            self.task_load.groupBy("topology_id", block.alias("block"))
            .agg(
                F.min("task").alias("begin_task"),
                F.max("task").alias("end_task"),
                F.sum("q").alias("load"),
            )
            .withColumn("__nation", F.col("block") % 25)
            .join(nation, "__nation")
            .select("topology_id", "begin_task", "end_task", "load", "node")
        )

    @cached_property
    def node(self) -> DataFrame:
        total = self.load.agg(F.sum("load").alias("total"))
        key = F.col("n_nationkey")
        capacity = F.call_function("div", total.scalar() * (key + 1), F.lit(325))
        return self.table("nation").select(
            F.col("n_name").alias("name"),
            capacity.cast("long").alias("capacity"),
            (1 + key % 8).cast("int").alias("cores"),
        )

    # Placement -----------------------------------------------------------------

    @cached_property
    def placement(self) -> DataFrame:
        """Executors on slots; the last declared slot of a topology stays empty."""
        slot = _div("begin_task", 4) % (2 + 2 * F.col("topology_id"))
        return self.load.select(
            "topology_id",
            "begin_task",
            "end_task",
            "load",
            slot.cast("int").alias("slot_id"),
            F.concat(F.lit("c"), (F.col("begin_task") % 5).cast("string")).alias("component"),
        )

    @cached_property
    def slot_node(self) -> DataFrame:
        nation = self.table("nation").select("n_nationkey", F.col("n_name").alias("node"))
        slots = self.placement.select("topology_id", "slot_id").distinct()
        key = (_div("slot_id", 2) * 3 + F.col("topology_id")) % 25
        return (
            slots.withColumn("n_nationkey", key)
            .join(nation, "n_nationkey")
            .select("topology_id", "slot_id", "node")
        )

    @cached_property
    def part_placement(self) -> DataFrame:
        """The placement with a third of the executors unplaced."""
        blank = _div("begin_task", 4) % 3 == 1
        return self.placement.withColumn("slot_id", F.when(~blank, F.col("slot_id")))

    @cached_property
    def part_state(self) -> DataFrame:
        held = slot_occupancy(self.part_placement.filter(F.col("slot_id").isNotNull()))
        return slot_state(declared_slots(self.params), held, slot_limits(self.params))

    @cached_property
    def part_slot_node(self) -> DataFrame:
        """The slots' nodes with some slots unplaced."""
        return self.slot_node.filter((F.col("slot_id") + F.col("topology_id")) % 3 != 1)

    @cached_property
    def part_node_state(self) -> DataFrame:
        ports = ports_per_host(self.node, self.ports)
        return node_occupancy(self.node, self.part_slot_node, self.occupancy, ports)

    @cached_property
    def params(self) -> DataFrame:
        sums = self.load.groupBy("topology_id").agg(
            F.count(F.lit(1)).cast("int").alias("executor_count"), F.sum("load").alias("total_load")
        )
        tid = F.col("topology_id")
        return sums.select(
            "topology_id",
            (3 + 2 * tid).alias("workers"),
            "executor_count",
            "total_load",
            F.when(tid % 2 != 0, (tid / F.lit(10.0)).cast("float")).alias("alfa"),
            F.when(tid % 3 != 0, (tid % 4 / F.lit(4.0)).cast("float")).alias("beta"),
            (1 + tid / F.lit(10.0)).cast("float").alias("gamma"),
            F.when(tid != 4, (tid / F.lit(10.0)).cast("float")).alias("delta"),
        )

    @cached_property
    def dag(self) -> DataFrame:
        """The component graph c0 -> (c1, c2) -> c3 -> c4 of every topology."""
        streams = F.create_map(
            F.lit("c1"),
            F.array(F.lit("c0")),
            F.lit("c2"),
            F.array(F.lit("c0")),
            F.lit("c3"),
            F.array(F.lit("c1"), F.lit("c2")),
            F.lit("c4"),
            F.array(F.lit("c3")),
        )
        components = F.array(*[F.lit(f"c{i}") for i in range(5)])
        return self.topology.select(
            "topology_id", components.alias("components"), streams.alias("streams")
        )

    @cached_property
    def conf(self) -> DataFrame:
        """Parameter sets as text, one per supplier, some out of range or missing."""
        key = F.col("s_suppkey")

        def tenths(value) -> Column:
            return F.concat(_div(value, 10).cast("string"), F.lit("."), (value % 10).cast("string"))

        def set_unless(test, value):
            return F.when(~test, value)

        conf = F.create_map(
            F.lit("alfa"),
            set_unless(key % 4 == 0, tenths(key % 13)),
            F.lit("beta"),
            set_unless(key % 5 == 0, tenths(key % 12)),
            F.lit("gamma"),
            set_unless(key % 3 == 0, tenths(key % 7 * 4)),
            F.lit("delta"),
            set_unless(key % 6 == 0, tenths(key % 11)),
            F.lit("traffic.improvement"),
            set_unless(key % 17 == 0, (key % 110).cast("string")),
            F.lit("reschedule.timeout"),
            set_unless(key % 2 == 0, (key * 60).cast("string")),
        )
        return self.table("supplier").select(
            key.cast("long").alias("conf_id"), (key % 120).cast("int").alias("capacity_pct"), conf.alias("conf")
        )

    @cached_property
    def ports(self) -> DataFrame:
        nation = self.table("nation").select("n_nationkey", F.col("n_name").alias("name"))
        key = F.col("s_suppkey")
        return (
            self.table("supplier")
            .select(
                F.col("s_nationkey").alias("n_nationkey"),
                (key % 7).cast("int").alias("port"),
                (key % 2 == 0).alias("used"),
            )
            .join(nation, "n_nationkey")
            .select("name", "port", "used")
        )

    # Event telemetry -----------------------------------------------------------

    @cached_property
    def receipts(self) -> DataFrame:
        return receipts_of(self.table("events"))

    @cached_property
    def cpu(self) -> DataFrame:
        """A cumulative counter per user; every 5,000 value units add one CPU second."""
        samples = self.table("events").select(
            F.col("user_id").alias("thread_id"),
            "ts",
            "event_id",
            F.round(F.col("value") * 100).cast("long").alias("__step"),
        )
        summed = running_sum(
            samples, ["thread_id"], ["ts", "event_id"], F.col("__step"), day_of("ts"), "cpu_total"
        )
        return summed.select("thread_id", "ts", "event_id", (F.col("cpu_total") * 2000).alias("cpu_total"))

    @cached_property
    def thread_tasks(self) -> DataFrame:
        return self.receipts.select(
            F.col("source_task").cast("long").alias("thread_id"),
            F.col("destination_task").alias("task_id"),
        ).distinct()

    @cached_property
    def thread_hosts(self) -> DataFrame:
        threads = self.table("events").select(F.col("user_id").alias("thread_id")).distinct()
        supplier = self.table("supplier").select("s_suppkey", F.col("s_name").alias("host"))
        return threads.join(
            supplier, F.col("s_suppkey") == F.col("thread_id") % 10
        ).select("thread_id", "host")

    @cached_property
    def cpuinfo(self) -> DataFrame:
        def block(processor: int, mhz) -> Column:
            return F.concat(
                F.lit(f"processor\t: {processor}\nmodel name\t: M"),
                F.col("s_nationkey").cast("string"),
                F.lit("\ncpu MHz\t: "),
                mhz,
                F.lit("\n"),
            )

        key = F.col("s_suppkey")
        body = F.concat(
            block(0, F.concat((1000 + key).cast("string"), F.lit(".937"))),
            F.lit("\n"),
            block(1, F.concat((2000 + key).cast("string"), F.lit(".5"))),
        )
        return self.table("supplier").select(F.col("s_name").alias("host"), body.alias("body"))

    @cached_property
    def cores(self) -> DataFrame:
        return parse_cpuinfo(self.cpuinfo)

    @cached_property
    def nation_speed(self) -> DataFrame:
        """Incoming node registrations: the processors of a nation's suppliers."""
        home = (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_name").alias("host"), F.col("n_name").alias("name"))
        )
        return (
            host_cpu_totals(self.cores)
            .join(home, "host")
            .groupBy("name")
            .agg(F.sum("total_hz").alias("total_hz"), F.sum("cores").cast("int").alias("cores"))
            .select("name", absolute_capacity("total_hz", F.lit(80)).alias("capacity"), "cores")
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        rows = snapshot_rows(self.table("events"))
        return rows.withColumn("snapshot", F.col("ts").cast("date")).drop("ts").distinct()

    @cached_property
    def snapshot_topologies(self) -> DataFrame:
        return self.table("events").select(
            F.col("ts").cast("date").alias("snapshot"),
            F.concat(F.lit("T"), (F.col("user_id") % 4).cast("string")).alias("topology_key"),
        ).distinct()

    @cached_property
    def evaluations(self) -> DataFrame:
        return evaluations_of(self.table("events"))

    # Shared intermediate results -----------------------------------------------

    def derive_executor_traffic(self) -> DataFrame:
        return executor_traffic(self.traffic, self.load)

    @cached_property
    def pairs(self) -> DataFrame:
        """Executor pairs, stored: every placement report starts from them, often twice."""
        return self._stored("executor_traffic", self.derive_executor_traffic)

    @cached_property
    def slot_pairs(self) -> DataFrame:
        return slot_traffic(self.pairs, self.placement)

    @cached_property
    def occupancy(self) -> DataFrame:
        return slot_occupancy(self.placement)

    @cached_property
    def state(self) -> DataFrame:
        return slot_state(declared_slots(self.params), self.occupancy, slot_limits(self.params))

    @cached_property
    def node_state(self) -> DataFrame:
        ports = ports_per_host(self.node, self.ports)
        return node_occupancy(self.node, self.slot_node, self.occupancy, ports)

    @cached_property
    def on_node(self) -> DataFrame:
        return topology_slots_on_node(self.slot_node)

    @cached_property
    def node_limits(self) -> DataFrame:
        count = self.node.agg(F.count(F.lit(1)).cast("int").alias("n"))
        return node_limits(self.params, count.scalar())

    @cached_property
    def proposed(self) -> DataFrame:
        return executor_nodes(self.placement, self.slot_node)


def receipts_of(events: DataFrame) -> DataFrame:
    """Receipts from event rows, batch or stream."""
    return events.select(
        F.col("event_type").alias("topology_key"),
        "ts",
        "event_id",
        F.col("user_id").cast("int").alias("source_task"),
        F.get_json_object("props", "$.k").cast("int").alias("destination_task"),
    )


def snapshot_rows(events: DataFrame) -> DataFrame:
    """Assignment rows from event rows, batch or stream; what is placed changes every other day."""
    shift = _div(F.unix_date(F.col("ts").cast("date")), 2)
    return events.select(
        "ts",
        F.col("event_type").alias("host"),
        (F.col("user_id") % 2).cast("int").alias("port"),
        F.concat(F.lit("c"), ((F.col("event_id") % 3 + shift) % 5).cast("string")).alias("executor"),
    )


def evaluations_of(events: DataFrame) -> DataFrame:
    """Evaluations from event rows, batch or stream."""
    current = F.round(F.col("value") * 100).cast("long")
    return events.select(
        F.col("event_type").alias("topology_key"),
        "event_id",
        F.col("ts").alias("eval_ts"),
        current.alias("current_traffic"),
        F.call_function("div", current * (F.col("event_id") % 100), F.lit(100)).alias("best_traffic"),
        (F.col("event_id") % 11 == 0).alias("relieves_overload"),
    )
