"""Streaming statistics: tuple counts, moving rates, counter deltas, stored stats.

Stateful steps run as separate queries joined by tables, so each restarts from
its own checkpoint.  State per key is a few numbers; a micro-batch of one key is
sorted in memory, so bound the batch at the source when catching up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowscope.sources.changelog import ChangeLog

PAIR = ["topology_key", "source_task", "destination_task"]


def stream_tuple_counts(receipts: DataFrame, slot_length: str, delay: str) -> DataFrame:
    """Counts per closed slot.  Receipts later than ``delay`` are dropped; Spark
    reports how many in the query progress (``numRowsDroppedByWatermark``).

    A row without a topology is an end marker (``sources.append_end_marker``): it closes the slots
    before it and counts nothing.  It is told by its count, not by a filter on the key, which
    would be pushed below the watermark and hide the marker from it.
    """
    slot = F.window("ts", slot_length).alias("__w")
    counted = receipts.withWatermark("ts", delay).groupBy(slot, *PAIR).agg(F.count(PAIR[0]).alias("tuples"))
    return counted.filter("tuples > 0").select(F.col("__w.start").alias("slot_start"), *PAIR, "tuples")


def _in_order(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    frames = list(batches)
    rows = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
    return rows if len(rows) == 1 else rows.sort_values(order, kind="stable")


def _rolling(rows: pd.DataFrame, slots: int, slot_length: int) -> pd.DataFrame:
    """Rates of rows sorted by pair and slot, over the last ``slots`` rows of each pair."""
    by_pair = rows.groupby(PAIR, sort=False)
    present = np.minimum(by_pair.cumcount().to_numpy() + 1, slots)
    running = np.concatenate([[0], rows["tuples"].to_numpy(np.int64).cumsum()])
    upto = np.arange(1, len(rows) + 1)
    total = running[upto] - running[upto - present]
    return rows.assign(
        rate=total // (present * slot_length), __left=by_pair.cumcount(ascending=False)
    )


def stream_moving_rate(
    counts: DataFrame, slots: int, slot_length: int, buckets: int = 256
) -> DataFrame:
    """Rate over the last ``slots`` present samples of each task pair.

    Pairs are hashed into ``buckets`` and the pairs of a bucket handled
    together as arrays: a Python call per pair would cost far more than the
    sums.  State of a bucket: the samples its pairs still need.  Choose about
    one bucket per few thousand pairs; the number is fixed once a checkpoint
    exists.  A sample not newer than one of its pair in an earlier micro-batch comes too late to
    be placed: it is passed on with a null ``rate``, so that it can be counted, and changes nothing.
    """
    output = (
        "topology_key string, source_task int, destination_task int, slot_start timestamp, rate long"
    )
    columns = [*PAIR, "slot", "tuples"]
    keep = max(slots - 1, 1)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        fresh = pd.concat(list(batches), ignore_index=True)
        fresh = fresh.assign(
            slot=fresh["slot_start"].astype("datetime64[us]").astype("int64"), __new=True
        )[[*columns, "__new"]]
        old = pd.DataFrame(dict(zip(columns, state.get, strict=True))) if state.exists else None
        missed = fresh.iloc[:0]
        if old is None or old.empty:
            rows = fresh
        else:
            newest = old.groupby(PAIR)["slot"].max().rename("__newest").reset_index()
            known = fresh.merge(newest, on=PAIR, how="left")
            late = known["slot"] <= known["__newest"].fillna(np.iinfo("int64").min)
            missed = known[late]
            fresh = known[~late].drop(columns="__newest")
            rows = pd.concat([old.assign(__new=False), fresh], ignore_index=True)
        rated = _rolling(rows.sort_values([*PAIR, "slot"], ignore_index=True), slots, slot_length)
        kept = rated[rated["__left"] < keep]
        state.update(tuple(kept[c].tolist() for c in columns))
        rated = rated.astype({"rate": "Int64"})
        out = pd.concat([rated[rated["__new"].astype(bool)], missed.assign(rate=pd.array([pd.NA] * len(missed), "Int64"))])
        yield out.assign(slot_start=pd.to_datetime(out["slot"], unit="us"))[
            [*PAIR, "slot_start", "rate"]
        ]

    bucket = F.pmod(F.xxhash64(*PAIR), F.lit(buckets)).cast("int")
    samples = counts.select(*PAIR, "slot_start", F.col("tuples").cast("long").alias("tuples"))
    return (
        samples.withColumn("__bucket", bucket)
        .groupBy("__bucket")
        .applyInPandasWithState(
            step,
            output,
            "topology_key array<string>, source_task array<int>, destination_task array<int>, "
            "slot array<long>, tuples array<long>",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )


def stream_counter_delta(samples: DataFrame, clock_hz: int) -> DataFrame:
    """CPU cycles between counter samples of a thread, across micro-batches.

    State: time, id and value of the newest sample.  Negative samples are dropped; a counter
    below its predecessor counts in full.  A sample that is not newer than one of an earlier
    micro-batch comes too late to be placed: it is passed on with null ``cycles``, so
    that late samples can be counted, and changes no other row.
    """
    output = "thread_id long, ts timestamp, event_id long, cpu_total long, cycles long"

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        newest_ts, newest_id, last = state.get if state.exists else (None, None, 0)
        rows = _in_order(batches, ["ts", "event_id"])
        late = pd.Series(False, index=rows.index)
        if newest_ts is not None:
            micros = rows["ts"].astype("datetime64[us]").astype("int64")
            late = (micros < newest_ts) | ((micros == newest_ts) & (rows["event_id"] <= newest_id))
        live = rows[~late]
        counter = live["cpu_total"]
        previous = counter.shift(fill_value=last)
        delta = (counter - previous).where(counter >= previous, counter)
        rows["cycles"] = (delta / 1e9 * float(clock_hz)).astype("int64").astype("Int64").reindex(rows.index)
        if len(live):
            end = live.iloc[-1]
            state.update((int(end["ts"].value // 1000), int(end["event_id"]), int(end["cpu_total"])))
        yield rows[["thread_id", "ts", "event_id", "cpu_total", "cycles"]]

    live = samples.filter(F.col("cpu_total") >= 0).select("thread_id", "ts", "event_id", "cpu_total")
    return live.groupBy("thread_id").applyInPandasWithState(
        step, output, "ts long, event_id long, last long", "append", GroupStateTimeout.NoTimeout
    )


def store_stats(stats: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Appends each micro-batch to a change log, one folder per batch.

    A batch that is run again after a failure overwrites its own folder, so the
    log holds every row once.  ``every`` sets the cycle; without it everything
    available is stored and the query ends.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        stats.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def store_changes(
    stats: DataFrame, log: ChangeLog, checkpoint: str, every: str | None = None, compact_every: int | None = None
):
    """Like ``store_stats``, into a change log that is compacted after every so many micro-batches."""

    def append(batch: DataFrame, batch_id: int) -> None:
        log.append(batch, f"batch-{batch_id:012d}")
        if compact_every and (batch_id + 1) % compact_every == 0:
            log.compact()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        stats.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def read_stats(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The change log that ``store_stats`` wrote."""
    with_batch = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(with_batch).parquet(path).drop("batch")
