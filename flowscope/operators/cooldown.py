"""Alerts with a minimum time between two of the same topology.

Whether an evaluation fires depends on the last fire, which is a sequential
rule.  To keep a busy topology off a single task its evaluations are cut into
time pieces of fixed length, whatever the timeouts, which may change from row to row:

1. per piece, for every possible time of the last fire before it, find the last
   fire inside it (a step function, few rows after equal steps are merged);
2. per topology, follow these functions from piece to piece;
3. per piece, now knowing the last fire before it, list the fires.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# One task sees this much time of one topology in steps 1 and 3.
PIECE_SECONDS = 6 * 3600
_NONE = np.iinfo(np.int64).min


def _ready(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows in time order, their times, and the latest last fire that lets one of the rows up to here fire."""
    pdf = pdf.sort_values("__ts", ignore_index=True)
    ts = pdf["__ts"].to_numpy(np.int64)
    return pdf, ts, np.maximum.accumulate(ts - pdf["__timeout"].to_numpy(np.int64))


def _next(ready: np.ndarray, last_fire: int) -> int:
    """The first row whose own timeout since the last fire is over."""
    return int(np.searchsorted(ready, last_fire, side="left"))


def _last_fires(ts: np.ndarray, ready: np.ndarray) -> np.ndarray:
    """For a fire at each time, the last fire of the piece it leads to."""
    own = np.arange(len(ts))
    following = np.searchsorted(ready, ts, side="left")
    jump = np.where(following < len(ts), following, own)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return ts[jump]
        jump = further


def _steps(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, ts, ready = _ready(pdf)
    # Last fires are before the piece, so rows behind the first that they all release don't matter.
    reachable = int(np.searchsorted(ready, int(pdf["__start"].iloc[0]), side="left")) + 1
    upto, exits = ready[:reachable], _last_fires(ts, ready)[:reachable]
    step = np.append(upto[1:] != upto[:-1], True)
    first = np.concatenate(([0], np.flatnonzero(step)[:-1] + 1))
    out = pdf.iloc[[0]][["topology_key", "__piece"]]
    out = out.loc[out.index.repeat(len(first))].reset_index(drop=True)
    return out.assign(__upto=upto[first], __exit=exits[first])


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["__piece", "__upto"])
    last_fire, pieces, entries = _NONE, [], []
    for piece, steps in pdf.groupby("__piece", sort=True):
        at = int(np.searchsorted(steps["__upto"].to_numpy(np.int64), last_fire, side="left"))
        if at < len(steps):
            pieces.append(piece)
            entries.append(last_fire)
            last_fire = int(steps["__exit"].iloc[at])
    key = pdf["topology_key"].iloc[0]
    return pd.DataFrame({"topology_key": key, "__piece": pieces, "__entry": entries})


def _fires(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, ts, ready = _ready(pdf)
    at, taken = _next(ready, int(pdf["__entry"].iloc[0])), []
    while at < len(ts):
        taken.append(at)
        at = _next(ready, int(ts[at]))
    return pdf.iloc[taken][["topology_key", "eval_ts", "event_id"]]


def cooldown_alerts(evaluations: DataFrame, piece_seconds: int = PIECE_SECONDS) -> DataFrame:
    """Evaluations that fire: the first wanted one, then any at least its own timeout after the last fire.

    Input ``topology_key, eval_ts, event_id, wanted, timeout_s``; only fires
    reset the clock.  Equal times of a topology are one evaluation, the one
    with the smallest id.
    """
    wanted = (
        evaluations.filter("wanted")
        .groupBy("topology_key", "eval_ts")
        .agg(F.min("event_id").alias("event_id"), F.min_by("timeout_s", "event_id").alias("__t"))
    )
    micros = F.unix_micros(F.col("eval_ts").cast("timestamp"))
    length = piece_seconds * 1_000_000
    cut = (
        # Times differ by a microsecond at least, so no timeout is the same as one of that length.
        wanted.withColumns({"__ts": micros, "__timeout": F.greatest(F.col("__t").cast("long") * 1_000_000, F.lit(1))})
        .withColumn("__piece", F.call_function("div", F.col("__ts") - F.pmod("__ts", F.lit(length)), F.lit(length)))
        .withColumn("__start", F.col("__piece") * length)
        .drop("__t")
    )
    group = ["topology_key", "__piece"]
    key = cut.schema["topology_key"].dataType.simpleString()
    steps = cut.groupBy(*group).applyInPandas(_steps, f"topology_key {key}, __piece long, __upto long, __exit long")
    entries = steps.groupBy("topology_key").applyInPandas(
        _walk, f"topology_key {key}, __piece long, __entry long"
    )
    ts_type = cut.schema["eval_ts"].dataType.simpleString()
    return (
        cut.join(entries, group)
        .groupBy(*group)
        .applyInPandas(_fires, f"topology_key {key}, eval_ts {ts_type}, event_id long")
    )
