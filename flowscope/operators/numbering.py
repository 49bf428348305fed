"""Exact positions without an unpartitioned or hot window.

``row_number() over (partition by topology order by traffic)`` sends a whole
topology to one task.  The helpers below split the ordering into levels, count
rows per level value, and add running counts (small tables) to a row number
taken inside the innermost level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# First hex digits of an md5 spread distinct keys evenly over 4,096 buckets.
_MD5_DIGITS = 3


def _ordered(name: str, ascending: bool) -> Column:
    return F.col(name).asc() if ascending else F.col(name).desc()


def hierarchical_rank(
    df: DataFrame,
    partition: Sequence[str],
    levels: Sequence[tuple[str, bool]],
    tie_break: Sequence[str],
    name: str = "position",
) -> DataFrame:
    """1-based rank within ``partition`` by ``levels`` (column, ascending), then ``tie_break``.

    Partition and level columns are never null.  Rows are shuffled once, on the
    partition and all levels.  Every running
    count is over the distinct values of one level inside its parent.  With
    whole-number traffic ``d`` distinct values need a total of ``d*d/2``, so a
    traffic level stays small however many rows share it.
    """
    prefix = [*partition, *(c for c, _ in levels)]
    # The joins below imply non-null keys; with that said up front every branch
    # scans alike and Spark computes the counts once.
    df = df.filter(" and ".join(f"`{c}` is not null" for c in prefix))
    counts = df.groupBy(*prefix).agg(F.count(F.lit(1)).alias("__n"))

    def with_before(granularity: DataFrame, depth: int) -> DataFrame:
        parent = prefix[: len(partition) + depth]
        window = (
            Window.partitionBy(*parent)
            .orderBy(_ordered(*levels[depth]))
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        before = F.coalesce(F.sum("__n").over(window), F.lit(0)).alias(f"__before{depth}")
        return granularity.select(*prefix[: len(partition) + depth + 1], before)

    offsets = with_before(counts, len(levels) - 1)
    for depth in range(len(levels) - 1):
        keys = prefix[: len(partition) + depth + 1]
        coarser = counts.groupBy(*keys).agg(F.sum("__n").alias("__n"))
        offsets = offsets.join(with_before(coarser, depth), keys)
    total = sum((F.col(f"__before{d}") for d in range(len(levels))), F.lit(0))
    offsets = offsets.select(*prefix, total.alias("__before"))
    inner = Window.partitionBy(*prefix).orderBy(*tie_break)
    return (
        df.join(offsets, prefix)
        .withColumn(name, F.col("__before") + F.row_number().over(inner))
        .drop("__before")
    )


def number_keys(keys: DataFrame, key: str, start: DataFrame | None = None) -> DataFrame:
    """Dense integer ids 1..n for distinct ``key`` values, in md5 order.

    ``start`` is an optional one-row frame with the highest id already in use.
    The running count is over at most 4,096 md5 buckets and the row number is
    taken inside one bucket, so no task sees all keys.
    """
    hashed = keys.select(key).distinct().withColumns(
        {
            "__md5": F.md5(F.col(key)),
            "__bucket": F.substring(F.md5(F.col(key)), 1, _MD5_DIGITS),
        }
    )
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy("__bucket")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    if start is not None:
        top = start.select(F.coalesce(F.col(start.columns[0]), F.lit(0)).alias("__top"))
        offsets = offsets.withColumn("__before", F.col("__before") + top.scalar())
    inner = Window.partitionBy("__bucket").orderBy("__md5", key)
    return hashed.join(offsets, "__bucket").select(
        (F.col("__before") + F.row_number().over(inner)).cast("int").alias("id"), key
    )


def pair_dimensions(left: DataFrame, right: DataFrame, right_key: str, buckets: int = 64) -> DataFrame:
    """Each row of one dimension table with each row of another.

    Only for results that hold one row per (topology, node) by definition.
    ``right`` is hashed into buckets and ``left`` meets every bucket, so this
    runs as a plain hash join spread over ``buckets`` keys.
    """
    fanned = left.withColumn("__pair", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    hashed = right.withColumn("__pair", F.pmod(F.xxhash64(right_key), F.lit(buckets)).cast("int"))
    return fanned.join(hashed, "__pair").drop("__pair")
