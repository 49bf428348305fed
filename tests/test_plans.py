"""Physical plans: no nested loops, no pair explosion, hot keys split."""

from __future__ import annotations

import re
import time
from contextlib import contextmanager
from types import SimpleNamespace

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from flowscope.operators import choose, pairing, placement, resolve, rollup
from flowscope.operators.joins import spread_join
from flowscope.plans.catalog import QUERIES, _loaded_pairs
from flowscope.runtime import stored, written

DATA = "/root/testdata/sf0.001"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
STREAMS = {name for name in QUERIES if name.startswith("stream_")}
# These write to a sink while the query is built.
SINKS = {"scan_tables", "sink_assignment_append"}


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def physical(df) -> str:
    return plan(df).split("== Physical Plan ==")[1]


@contextmanager
def settings(spark, **conf):
    conf = {f"spark.sql.{k.replace('__', '.')}": str(v) for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - STREAMS - SINKS))
def test_no_pairwise_join_and_no_forced_broadcast(spark, name):
    """With the size limit off nothing may be broadcast: there are no hints."""
    with settings(spark, autoBroadcastJoinThreshold=-1):
        text = physical(QUERIES[name](spark, DATA))
    for join in ("BroadcastNestedLoopJoin", "CartesianProduct", "BroadcastHashJoin"):
        assert join not in text


def edges(spark, rows=200_000):
    """A third of all edges leave one task."""
    hot = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise((F.col("id") % 1000).cast("int"))
    return spark.range(rows).select(
        (F.col("id") % 1 + 1).cast("int").alias("topology_id"),
        hot.alias("source_task"),
        (1000 + F.col("id") % 5000).cast("int").alias("destination_task"),
        (F.col("id") % 1 + 1).cast("int").alias("traffic"),
    )


def executors(spark):
    return spark.range(750).select(
        (F.col("id") % 1 + 1).cast("int").alias("topology_id"),
        (F.col("id") * 8).cast("int").alias("begin_task"),
        (F.col("id") * 8 + 7).cast("int").alias("end_task"),
        F.lit(1).cast("long").alias("load"),
        F.concat(F.lit("n"), F.col("id") % 5).alias("node"),
    )


def test_a_hot_task_is_split_at_run_time(spark, tmp_path):
    edges(spark).repartition(16).write.parquet(f"{tmp_path}/edges")
    with settings(
        spark,
        autoBroadcastJoinThreshold=-1,
        adaptive__autoBroadcastJoinThreshold=-1,
        adaptive__advisoryPartitionSizeInBytes="64KB",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="64KB",
        adaptive__skewJoin__skewedPartitionFactor=2,
        shuffle__partitions=32,
    ):
        df = rollup.executor_traffic(spark.read.parquet(f"{tmp_path}/edges"), executors(spark))
        total = sum(r.traffic for r in df.collect())
        text = physical(df)
    assert total == 200_000
    assert re.search(r"SortMergeJoin\(skew=true\)|isSkew=true|skewed", text)


def test_edges_are_summed_before_they_are_shuffled(spark):
    text = physical(rollup.executor_traffic(edges(spark, 100), executors(spark)))
    assert "partial_sum(traffic" in text


def test_top_k_is_limited_before_the_shuffle(spark):
    pairs = rollup.executor_traffic(edges(spark, 100), executors(spark))
    text = physical(choose.top_executor_pairs(pairs, 3))
    assert re.search(r"WindowGroupLimit .*Partial", text) and re.search(r"WindowGroupLimit .*Final", text)


def test_full_rank_windows_never_span_a_topology_of_rows(spark):
    """Row windows are inside (topology, traffic, source); topology-wide ones see counts only."""
    pairs = rollup.executor_traffic(edges(spark, 100), executors(spark))
    text = physical(choose.rank_executor_traffic(pairs))
    for line in text.splitlines():
        if "row_number()" in line and "Window [" in line:
            spec = line.split("windowspecdefinition(")[1]
            assert spec.startswith("topology_id") and "traffic" in spec.split(" ASC")[0]


def test_only_needed_columns_are_scanned(spark):
    text = physical(QUERIES["format_ts"](spark, DATA))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_results_do_not_depend_on_partitioning(spark):
    base = edges(spark, 3000)
    one = rollup.executor_traffic(base, executors(spark))
    other = rollup.executor_traffic(base.repartition(7), executors(spark).repartition(3))
    assert as_set(one) == as_set(other)


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_a_spread_join_is_a_join(spark, how):
    rows = edges(spark, 500).withColumn("noise", F.create_map(F.lit("a"), F.col("traffic")))
    table = spark.range(0, 40, 3).select(F.col("id").cast("int").alias("source_task"), F.lit("x").alias("v"))
    columns = ["source_task", "destination_task", *(["v"] if how in ("inner", "left") else [])]
    plain = rows.join(table, "source_task", how).select(*columns)
    for spread_by in (["destination_task"], ["noise"], []):
        spread = spread_join(rows, table, ["source_task"], spread_by, how).select(*columns)
        assert sorted(map(tuple, spread.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


@pytest.mark.parametrize("which", ["edges", "tasks", "pairs", "sides"])
def test_what_has_a_row_per_task_or_executor_is_not_broadcast(spark, tmp_path, which):
    """A few wide ranges are a small file, their tasks are not."""
    few = executors(spark).filter("begin_task < 40").withColumn("end_task", F.col("end_task") + 5_000_000)
    few.write.parquet(f"{tmp_path}/executors")
    table = spark.read.parquet(f"{tmp_path}/executors").withColumn("slot_id", F.lit(1))
    edges(spark, 1000).write.parquet(f"{tmp_path}/edges")
    traffic = spark.read.parquet(f"{tmp_path}/edges")
    own, other = F.col("source_task"), F.col("destination_task")
    ends = {"src_begin": own, "src_end": own, "dst_begin": other, "dst_end": other}
    with settings(spark, autoBroadcastJoinThreshold="10MB"):
        if which == "edges":
            df = resolve.resolve_edges(traffic, table, keep=["node"])
        elif which == "tasks":
            df = resolve.resolve_tasks(traffic.withColumn("task", own), table)
        elif which == "pairs":
            df = rollup.place_pairs(traffic.withColumns(ends), table)
        else:
            units = table.withColumn("place", F.lit(1)).withColumn("home", F.lit(0))
            aff = table.withColumn("place", F.lit(1)).withColumn("affinity", F.lit(0))
            pairs = pairing._undirected(traffic.withColumns(ends))
            df = pairing._sides(pairs, units, aff, ["begin_task", "end_task"])
        text = physical(df)
    assert "SortMergeJoin" in text and "Broadcast" not in text


@pytest.mark.parametrize("which", ["unknown", "homes", "loaded", "nodes", "declared", "slots"])
def test_executors_are_merged_however_small_their_file(spark, tmp_path, which):
    executors(spark).write.parquet(f"{tmp_path}/executors")
    table = spark.read.parquet(f"{tmp_path}/executors")
    placed = table.withColumn("slot_id", F.col("begin_task") % 3)
    units = placed.withColumn("place", F.col("slot_id"))
    own, other = F.col("source_task"), F.col("destination_task")
    ends = {"src_begin": own, "src_end": own + 7, "dst_begin": other, "dst_end": other + 7}
    edges(spark, 1000).withColumns(ends).write.parquet(f"{tmp_path}/pairs")
    pairs = spark.read.parquet(f"{tmp_path}/pairs")
    aff = pairs.select("topology_id", F.col("src_begin").alias("begin_task"), F.col("src_end").alias("end_task"),
                       F.lit(1).alias("place"), F.col("traffic").alias("affinity"))
    with settings(spark, autoBroadcastJoinThreshold="10MB"):
        if which == "unknown":
            df = pairing._unknown(aff, units)
        elif which == "homes":
            df = pairing._homes(units, aff, ["begin_task", "end_task"])
        elif which == "loaded":
            df = _loaded_pairs(SimpleNamespace(pairs=pairs, load=table))
        elif which == "nodes":
            where = placed.select("topology_id", "slot_id", "node").distinct()
            df = rollup.executor_nodes(placed, where).filter("node is not null")
        elif which == "declared":
            df = resolve.match_executors(table, placed.select("topology_id", "begin_task", "end_task", "slot_id"))
        else:
            df = placement.executor_to_slot(table.select("topology_id", "begin_task", "end_task"), placed)
        text = physical(df)
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_slots_in_use_are_counted_once_each_before_they_are_looked_up(spark):
    """Six slots hold 600 executors; what is looked up has a row per slot."""
    slots = spark.range(8).select(F.lit(1).alias("topology_id"), F.col("id").cast("int").alias("slot_id"))
    placed = spark.range(600).select(F.lit(1).alias("topology_id"), (F.col("id") % 6).cast("int").alias("slot_id"))
    for lookup, found in ((placement.empty_slots, {6, 7}), (placement.used_slots, set(range(6)))):
        df = lookup(slots, placed)
        assert sorted(r.slot_id for r in df.collect()) == sorted(found)
        assert "HashAggregate" in physical(lookup(slots, placed))


def test_a_stored_table_is_written_in_small_parts(spark):
    """About 20 MB of shuffle: Spark's 64 MB a task would make one task of it."""
    rows = spark.range(1_500_000).select(F.xxhash64("id").alias("k"))
    with settings(spark, adaptive__coalescePartitions__parallelismFirst=False):
        before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
        df = stored(spark, "small-parts", lambda: rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None) == before
        assert len(df.inputFiles()) > 1 and df.count() == 1_500_000


def test_a_written_table_leaves_no_shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))

    def shuffles() -> set[str]:
        found = files.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before, kept = shuffles(), spark.conf.get(CLEANUP)
    tables = [written(sums, "sums"), stored(spark, "sums", lambda: sums)]
    deadline = time.monotonic() + 20
    while shuffles() - before and time.monotonic() < deadline:
        time.sleep(0.2)
    assert not shuffles() - before
    assert spark.conf.get(CLEANUP) == kept
    assert [t.agg(F.sum("n")).first()[0] for t in (*tables, sums)] == [1000] * 3
