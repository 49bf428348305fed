"""Time series operators: counts per slot, counter deltas, moving rates.

A single key may own a large share of all samples, so windows are not opened
over a whole key.  Every series is cut into pieces (a day by default); what a
piece needs from earlier ones - a last value, a running sum, the last N-1
samples - is computed from one small row per (key, piece) and joined back.
The join and the window share the partitioning (key, piece), so the samples
are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_of(ts: str) -> Column:
    return F.col(ts).cast("date")


def _piece_window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, "__piece").orderBy(*order)


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    piece: Column,
    name: str,
) -> DataFrame:
    """``lag(value)`` per key over the whole series, null on the first row."""
    cut = df.withColumn("__piece", piece)
    last = cut.groupBy(*keys, "__piece").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    over_pieces = Window.partitionBy(*keys).orderBy("__piece")
    carry = last.select(*keys, "__piece", F.lag("__last").over(over_pieces).alias("__carry"))
    inside = F.lag(value).over(_piece_window(keys, order))
    return (
        cut.join(carry, [*keys, "__piece"])
        .withColumn(name, F.coalesce(inside, F.col("__carry")))
        .drop("__piece", "__carry")
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    piece: Column,
    name: str,
) -> DataFrame:
    """Cumulative sum per key over the whole series."""
    cut = df.withColumns({"__piece": piece, "__value": value})
    sums = cut.groupBy(*keys, "__piece").agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(
        *keys, "__piece", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__carry")
    )
    so_far = F.sum("__value").over(
        _piece_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        cut.join(carry, [*keys, "__piece"])
        .withColumn(name, so_far + F.col("__carry"))
        .drop("__piece", "__value", "__carry")
    )


def tuple_counts(
    receipts: DataFrame, slot_length: str, keys: Sequence[str] = ("source_task", "destination_task")
) -> DataFrame:
    """Tuples per (slot window, topology, source, destination): ``slot_start, ..., tuples``."""
    return (
        receipts.groupBy(F.window("ts", slot_length).alias("__w"), "topology_key", *keys)
        .agg(F.count(F.lit(1)).alias("tuples"))
        .select(F.col("__w.start").alias("slot_start"), "topology_key", *keys, "tuples")
    )


def counter_delta(
    samples: DataFrame,
    clock_hz: int,
    key: str = "thread_id",
    order: Sequence[str] = ("ts", "event_id"),
    counter: str = "cpu_total",
    piece: Column | None = None,
) -> DataFrame:
    """CPU cycles between samples of a cumulative nanosecond counter, as ``cycles``.

    The first sample counts in full.  A counter below its predecessor has been
    reset and also counts in full; negative samples come from ended threads
    and are dropped.
    """
    piece = day_of(order[0]) if piece is None else piece
    live = samples.filter(F.col(counter) >= 0)
    lagged = previous_value(live, [key], order, counter, piece, "__previous")
    previous = F.coalesce(F.col("__previous"), F.lit(0))
    delta = F.when(F.col(counter) < previous, F.col(counter)).otherwise(F.col(counter) - previous)
    seconds = delta.cast("double") / F.lit(1e9)
    return lagged.withColumn("cycles", (seconds * F.lit(float(clock_hz))).cast("long")).drop(
        "__previous"
    )


def moving_rate(
    samples: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    slots: int,
    slot_length: int,
    piece: Column | None = None,
) -> DataFrame:
    """Mean per unit of time over the last ``slots`` present samples, as ``rate``.

    ``sum div (count * slot_length)`` in whole numbers; a series that is still
    shorter than ``slots`` divides by what is there.
    """
    cut = samples.withColumn("__piece", day_of(order[0]) if piece is None else piece)
    if slots == 1:
        total, count = F.col(value), F.lit(1)
        return cut.withColumn("rate", _per_time(total, count, slot_length)).drop("__piece")
    # Last samples of each piece; at most slots - 1 of them per (key, piece).
    newest_first = Window.partitionBy(*keys, "__piece").orderBy(*[F.col(c).desc() for c in order])
    tails = (
        cut.withColumn("__back", F.row_number().over(newest_first))
        .filter(F.col("__back") < slots)
        .groupBy(*keys, "__piece")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))),
                lambda s: s["__v"],
            ).alias("__tail")
        )
    )
    earlier = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(-(slots - 1), -1)
    carry = tails.select(
        *keys,
        "__piece",
        _last(F.flatten(F.collect_list("__tail").over(earlier)), F.lit(slots - 1)).alias("__carry"),
    )
    window = _piece_window(keys, order)
    frame = window.rowsBetween(-(slots - 1), 0)
    joined = (
        cut.join(carry, [*keys, "__piece"])
        .withColumns({"__in_sum": F.sum(value).over(frame), "__in_n": F.count(F.lit(1)).over(frame)})
        .withColumn("__old", _last(F.col("__carry"), F.lit(slots) - F.col("__in_n")))
    )
    old_sum = F.aggregate("__old", F.lit(0).cast("long"), lambda acc, v: acc + v)
    total = F.col("__in_sum") + old_sum
    count = F.col("__in_n") + F.size("__old")
    return joined.withColumn("rate", _per_time(total, count, slot_length)).drop(
        "__piece", "__carry", "__in_sum", "__in_n", "__old"
    )


def _per_time(total: Column, count: Column, slot_length: int) -> Column:
    return F.call_function("div", total.cast("long"), (count * slot_length).cast("long"))


def _last(items: Column, n: Column) -> Column:
    """The last ``n`` items, or all if there are fewer."""
    size = F.size(items).cast("long")
    take = F.least(size, n.cast("long"))
    return F.slice(items, (size - take + 1).cast("int"), take.cast("int"))


def latest_sample(
    samples: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """The last row's ``columns`` per key; partial maxima are merged map-side."""
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("__last")
    return samples.groupBy(*keys).agg(newest).select(*keys, "__last.*")


def host_usage_pct(
    samples: DataFrame, thread_hosts: DataFrame, hosts: DataFrame, slot_length: int
) -> DataFrame:
    """Whole percent of a host's total speed that its threads used in their last slot."""
    last = latest_sample(samples, ["thread_id"], ["ts", "event_id"], ["cycles"])
    per_host = (
        last.join(thread_hosts, "thread_id")
        .groupBy("host")
        .agg(F.sum(F.call_function("div", F.col("cycles"), F.lit(slot_length))).alias("used_hz"))
    )
    share = F.col("used_hz").cast("double") / F.col("total_hz").cast("double") * F.lit(100.0)
    return per_host.join(hosts, "host").select(
        "host", "used_hz", "total_hz", share.cast("int").alias("usage_pct")
    )
