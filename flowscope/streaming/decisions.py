"""Streaming decisions: alerts with a cool-down, and assignment changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowscope.operators.history import CONTENT, digested


def stream_cooldown_alerts(evaluations: DataFrame) -> DataFrame:
    """Wanted changes, at most one per topology and timeout; only fires reset the clock.

    Input as for the batch operator.  State: the time of the last fire.
    """
    output = "topology_key string, eval_ts timestamp, event_id long"

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        last = pd.Timestamp(state.get[0] * 1000) if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True)
        rows = rows.sort_values(["eval_ts", "event_id"]).reset_index(drop=True)
        waits = pd.to_timedelta(rows["timeout_s"], unit="s")
        fired = []
        for at, (time, wait) in enumerate(zip(rows["eval_ts"], waits, strict=True)):
            if last is None or (time > last and time >= last + wait):
                fired.append(at)
                last = time
        if last is not None:
            state.update((last.value // 1000,))
        yield rows.iloc[fired][["topology_key", "eval_ts", "event_id"]]

    wanted = evaluations.filter("wanted").select("topology_key", "eval_ts", "event_id", "timeout_s")
    return wanted.groupBy("topology_key").applyInPandasWithState(
        step, output, "last_fire long", "append", GroupStateTimeout.NoTimeout
    )


def stream_fingerprints(rows: DataFrame, every: str, delay: str) -> DataFrame:
    """A digest of each closed snapshot from rows ``ts, cluster, host, port, executor``.

    A snapshot is all rows of one ``every`` window.  Rows are made distinct one by one and the
    digest is a sum, so no state holds a snapshot as a whole.  A row without a host is an end
    marker (``sources.append_end_marker``): it closes the snapshots before it.
    """
    window = F.window("ts", every).alias("__w")
    distinct = rows.withWatermark("ts", delay).groupBy(window, "cluster", *CONTENT).agg(F.count(F.lit(1)).alias("__n"))
    # Told by the count: a filter on a key would be pushed below the watermark and hide the markers.
    marks = digested(distinct, ["__w", "cluster"], CONTENT).filter("rows > 0")
    return marks.select("cluster", F.col("__w.start").alias("snapshot"), "fingerprint")


def stream_assignment_changes(fingerprints: DataFrame, every: str | None = None) -> DataFrame:
    """Snapshots whose digest differs from the one before, per cluster.

    ``every`` is the time from one snapshot to the next: where one is missing, nothing was
    assigned then, so the next differs from it whatever its digest.  State: the last digest and
    its time.
    """
    output = "cluster string, snapshot timestamp"
    step_time = pd.Timedelta(every) if every else None

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        last, at = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches), ignore_index=True).sort_values("snapshot")
        changed = rows["fingerprint"] != rows["fingerprint"].shift(fill_value=last or "")
        if step_time is not None:
            before = rows["snapshot"].shift()
            if at is not None:
                before.iloc[0] = pd.Timestamp(at * 1000)
            changed |= rows["snapshot"] - before > step_time
        state.update((rows["fingerprint"].iloc[-1], rows["snapshot"].iloc[-1].value // 1000))
        yield rows[changed][["cluster", "snapshot"]]

    return fingerprints.groupBy("cluster").applyInPandasWithState(
        step, output, "last string, at long", "append", GroupStateTimeout.NoTimeout
    )
