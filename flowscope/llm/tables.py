"""Small DataFrame helpers of the operators in this folder."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowscope.runtime import scratch_path


# Documents are some kilobytes each, so that Spark's default of 10,000 rows a batch would hold
# tens of megabytes several times over in every task.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to a size fit for rows with whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a partition's batches; what it held goes back to the system at its end.

    A worker process serves many tasks, and its allocators would keep the largest one's memory.
    """

    @functools.wraps(run)
    def over(batches: Iterator) -> Iterator:
        yield from run(batches)
        _give_back()

    return over


def lean_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` over one large group; what it held goes back to the system at its end."""

    @functools.wraps(run)
    def over(group: pa.Table) -> pa.Table:
        out = run(group)
        _give_back()
        return out

    return over


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: its lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name = f"__{stem}_{uuid.uuid4().hex[:6]}"
    return name


def column(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the names the operators use: ``only(docs, text="body")``."""
    return df.select(*[column(c).alias(k) for k, c in columns.items()])


def learn_share(id_column: Column, parts: int, held: int) -> Column:
    """True for rows whose id, as text, has a CRC-32 with another remainder than ``held``.

    A null id counts as the empty text.
    """
    text = F.coalesce(id_column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % parts != held


def sampled(rows: DataFrame, by: str, order: str, n: int, groups: int) -> DataFrame:
    """``n`` rows of each value of ``by``, those whose ``order`` (a hash) ends in the smallest numbers.

    A share that leaves about four times as many is taken first, so that no group, however
    large, is sorted as a whole.  There may be ``groups`` values of ``by`` at most.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().limit(groups + 1).collect()}
    if len(counts) > groups:
        raise ValueError(f"more than {groups} values of {by}")
    if not counts:
        return rows.limit(0)
    tail = F.pmod(F.col(order), F.lit(1 << 30))
    limits = [x for k, c in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, (4 * n + 64) / c) * (1 << 30))))]
    near = rows.filter(tail < F.create_map(*limits)[F.col(by)])
    rank = F.row_number().over(Window.partitionBy(by).orderBy(tail, *rows.columns))
    name = fresh(rows, "rank")
    return near.withColumn(name, rank).filter(F.col(name) <= n).drop(name)
