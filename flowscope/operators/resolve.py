"""Tasks to the executors that contain them (point in inclusive range)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.operators.joins import spread_join
from flowscope.schema import EXECUTOR

# Wide ranges are first cut into cells of this many tasks, so that no row ever
# carries an array longer than the number of its cells.
CELL = 1024


def includes(begin: str, end: str, task: str) -> Column:
    """Inclusive range membership."""
    return F.col(task).between(F.col(begin), F.col(end))


def task_index(executors: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per (topology, task): the executor that owns the task.

    Ranges are unrolled to tasks, which turns the range lookup into an equi
    join; the size is the number of tasks that exist.  Where ranges overlap the
    one with the smallest (begin, end) wins.  ``keep`` adds executor columns.
    """
    keep = keep or []
    cells = F.sequence(
        F.lit(0), F.call_function("div", F.col("end_task") - F.col("begin_task"), F.lit(CELL))
    )
    first = F.col("begin_task") + F.col("__cell").cast("int") * CELL
    owner = F.struct("begin_task", "end_task", *keep)
    return (
        executors.select(*EXECUTOR, *keep)
        .withColumn("__cell", F.explode(cells))
        .withColumn(
            "task", F.explode(F.sequence(first, F.least(F.col("end_task"), first + (CELL - 1))))
        )
        .groupBy("topology_id", "task")
        .agg(F.min(owner).alias("__owner"))
        .select("topology_id", "task", "__owner.*")
    )


def resolve_tasks(tasks: DataFrame, executors: DataFrame, task: str = "task") -> DataFrame:
    """Adds ``begin_task`` and ``end_task``, null where no executor owns the task."""
    # Merged: the optimizer takes the index for as small as the ranges it is unrolled from.
    index = task_index(executors).withColumnRenamed("task", task).hint("merge")
    return tasks.join(index, ["topology_id", task], "left")


def resolve_edges(traffic: DataFrame, executors: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Both ends of every traffic edge: ``src_*`` and ``dst_*``, null where unresolved.

    The joins run on (topology, task); a task that takes part in very many
    edges is spread by the task at the other end.
    """
    keep = keep or []
    index = task_index(executors, keep)

    def side(prefix: str, task: str) -> DataFrame:
        return index.select(
            "topology_id",
            F.col("task").alias(task),
            F.col("begin_task").alias(f"{prefix}_begin"),
            F.col("end_task").alias(f"{prefix}_end"),
            *[F.col(c).alias(f"{prefix}_{c}") for c in keep],
        )

    at_source = spread_join(
        traffic,
        side("src", "source_task"),
        ["topology_id", "source_task"],
        ["destination_task"],
        grows=True,
    )
    return spread_join(
        at_source,
        side("dst", "destination_task"),
        ["topology_id", "destination_task"],
        ["source_task"],
        grows=True,
    )


def is_resolved() -> Column:
    return F.col("src_begin").isNotNull() & F.col("dst_begin").isNotNull()


def match_executors(measured: DataFrame, declared: DataFrame) -> DataFrame:
    """Measured executors that are declared with exactly the same range."""
    extra = [c for c in declared.columns if c not in measured.columns]
    return measured.join(declared.select(*EXECUTOR, *extra).hint("merge"), EXECUTOR)


def join_load_topology(load: DataFrame, topology: DataFrame) -> DataFrame:
    return spread_join(load, topology, ["topology_id"], ["begin_task", "end_task"], "inner")


def join_load_node(load: DataFrame, node: DataFrame) -> DataFrame:
    named = node.withColumnRenamed("name", "node")
    return spread_join(load, named, ["node"], ["begin_task", "end_task"], "inner")


def filter_topologies(df: DataFrame, topology: DataFrame, keys: list[str]) -> DataFrame:
    """Load or placement rows of the named topologies; all keys in one pass."""
    wanted = topology.filter(F.col("topology_key").isin(keys)).select("topology_id", "topology_key")
    return spread_join(df, wanted, ["topology_id"], ["begin_task", "end_task"], "inner")
