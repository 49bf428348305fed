"""Streams over several micro-batches give what the batch operators give."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from flowscope.operators import cooldown, history, series
from flowscope.schema import RECEIPT
from flowscope.streaming import decisions, stats
from flowscope.streaming.sources import append_end_marker, read_files, receipts_from_json, run_to_end

DAY0 = dt.datetime(2024, 1, 1)
RECEIPTS = "ts timestamp, topology_key string, source_task int, destination_task int"


def arrive(spark, root, schema, batch):
    """One more file in the source folder."""
    spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")


def feed(spark, root, schema, batches):
    """Files written one after another, read one per micro-batch."""
    for batch in batches:
        arrive(spark, root, schema, batch)
    return read_files(spark, f"{root}/in", spark.createDataFrame([], schema).schema, max_files=1)


def landed(spark, stream, root, label):
    run_to_end(stream, f"{root}/{label}", f"{root}/{label}-checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{root}/{label}")


def relay(spark, df, root, label):
    return read_files(spark, f"{root}/{label}", df.schema)


@pytest.fixture
def receipts():
    rng = random.Random(1)
    clock, rows = DAY0, []
    for _ in range(600):
        clock += dt.timedelta(seconds=rng.randrange(60))
        rows.append((clock, rng.choice("xy"), rng.randrange(2), rng.randrange(2)))
    return [rows[i : i + 150] for i in range(0, 600, 150)]


def test_counts_and_rates(spark, tmp_path, receipts):
    """Both queries stop and restart from their checkpoints for every file."""
    keys = ["topology_key", "source_task", "destination_task"]
    for batch in receipts:
        source = feed(spark, tmp_path, RECEIPTS, [batch])
        counts = landed(
            spark, stats.stream_tuple_counts(source, "10 minutes", "1 minute"), tmp_path, "counts"
        )
        rates = stats.stream_moving_rate(relay(spark, counts, tmp_path, "counts"), 3, 2)
        stats.store_stats(rates, f"{tmp_path}/log", f"{tmp_path}/log-checkpoint").awaitTermination()
    everything = [r for batch in receipts for r in batch]
    closed = max(r[0] for r in everything) - dt.timedelta(minutes=11)
    batch = series.tuple_counts(spark.createDataFrame(everything, RECEIPTS), "10 minutes")
    expected = batch.filter(F.col("slot_start") <= F.lit(closed))
    counts = spark.read.schema(counts.schema).parquet(f"{tmp_path}/counts")
    assert as_set(counts) == as_set(expected)
    twin = series.moving_rate(expected, keys, ["slot_start"], "tuples", 3, 2)
    stored = stats.read_stats(spark, f"{tmp_path}/log", rates.schema)
    assert as_set(stored, *keys, "slot_start", "rate") == as_set(twin, *keys, "slot_start", "rate")


def test_late_receipts_are_dropped(spark, tmp_path):
    """A slot that has been emitted takes no more receipts."""
    on_time = [(DAY0 + dt.timedelta(minutes=m), "x", 0, 1) for m in range(0, 60, 5)]
    later = [(DAY0 + dt.timedelta(hours=2), "x", 0, 1)]
    late = [(DAY0, "x", 0, 1), (DAY0 + dt.timedelta(hours=3), "x", 0, 1)]
    source = feed(spark, tmp_path, RECEIPTS, [on_time, later, late])
    counts = landed(spark, stats.stream_tuple_counts(source, "10 minutes", "1 minute"), tmp_path, "counts")
    assert {r.tuples for r in counts.filter(F.col("slot_start") == F.lit(DAY0)).collect()} == {2}


def test_counter_delta(spark, tmp_path):
    schema = "thread_id long, ts timestamp, event_id long, cpu_total long"
    values = [5, 9, 3, -1, 8, 8, 2, 20]
    rows = [(k, DAY0 + dt.timedelta(minutes=i), i, v * 10**9) for i, v in enumerate(values) for k in (1, 2)]
    source = feed(spark, tmp_path, schema, [rows[:4], rows[4:10], rows[10:]])
    got = landed(spark, stats.stream_counter_delta(source, 1000), tmp_path, "cycles")
    twin = series.counter_delta(spark.createDataFrame(rows, schema), 1000)
    columns = ["thread_id", "event_id", "cycles"]
    assert as_set(got, *columns) == as_set(twin, *columns)
    assert as_set(got.filter("thread_id = 1"), "event_id", "cycles") >= {(0, 5000), (2, 3000), (4, 5000)}


def test_a_late_sample_is_passed_on_without_cycles(spark, tmp_path):
    schema = "thread_id long, ts timestamp, event_id long, cpu_total long"
    rows = [(1, DAY0 + dt.timedelta(seconds=s), s, s * 10**9) for s in (10, 30, 20, 40)]
    source = feed(spark, tmp_path, schema, [rows[:2], rows[2:]])
    got = landed(spark, stats.stream_counter_delta(source, 1000), tmp_path, "late")
    assert as_set(got, "event_id", "cycles") == {(10, 10_000), (30, 20_000), (20, None), (40, 10_000)}


def test_alerts(spark, tmp_path):
    schema = "topology_key string, eval_ts timestamp, event_id long, wanted boolean, timeout_s int"
    rng = random.Random(2)
    clock, rows = DAY0, []
    for i in range(300):
        clock += dt.timedelta(seconds=rng.randrange(40))
        rows.append((rng.choice("ab"), clock, i, rng.random() < 0.7, rng.choice([90, 300])))
    source = feed(spark, tmp_path, schema, [rows[:100], rows[100:150], rows[150:]])
    got = landed(spark, decisions.stream_cooldown_alerts(source), tmp_path, "alerts")
    twin = cooldown.cooldown_alerts(spark.createDataFrame(rows, schema), 300)
    assert as_set(got, "event_id") == as_set(twin, "event_id")


def test_assignment_changes(spark, tmp_path):
    schema = "ts timestamp, cluster string, host string, port int, executor string"
    rng = random.Random(4)
    days = []
    for d in range(12):
        full = rng.random() < 0.5
        rows = [(DAY0 + dt.timedelta(days=d, hours=h), "c", "a", 1, e) for h, e in enumerate("xy")]
        days.append(rows if full else rows[:1])
    for i in (0, 4, 8):
        source = feed(spark, tmp_path, schema, [sum(days[i : i + 4], [])])
        marks = landed(spark, decisions.stream_fingerprints(source, "1 day", "1 hour"), tmp_path, "marks")
        stream = relay(spark, marks, tmp_path, "marks")
        got = landed(spark, decisions.stream_assignment_changes(stream), tmp_path, "changes")
    rows = spark.createDataFrame(sum(days[:-1], []), schema).withColumn("snapshot", F.to_date("ts"))
    expected = as_set(history.assignment_changes(rows))
    assert {(r.snapshot.date(),) for r in got.collect()} == expected


def test_json_messages(spark):
    body = json.dumps(
        {"ts": "2024-01-01T00:00:00Z", "topology_key": "x", "source_task": 1, "destination_task": 2}
    )
    parsed = receipts_from_json(spark.createDataFrame([(bytearray(body, "utf8"),)], "value binary"))
    assert parsed.columns == RECEIPT.fieldNames()
    assert as_set(parsed, "topology_key", "source_task", "destination_task") == {("x", 1, 2)}


def test_an_end_marker_closes_the_last_slot(spark, tmp_path, receipts):
    """Twice: with more files after the first marker, whose slots are still in time."""
    first, second = receipts[0] + receipts[1], receipts[2] + receipts[3]
    cut = max(r[0] for r in first).replace(second=0) + dt.timedelta(minutes=10)
    second = [r for r in second if r[0] >= cut]  # the next slot and later
    done: list = []
    for batch in (first, second):
        source = feed(spark, tmp_path, RECEIPTS, [batch])
        last = max(r[0] for r in batch)
        append_end_marker(spark, f"{tmp_path}/in", source.schema, last, "10 minutes", "1 minute")
        counts = landed(spark, stats.stream_tuple_counts(source, "10 minutes", "1 minute"), tmp_path, "ended")
        done += batch
        expected = series.tuple_counts(spark.createDataFrame(done, RECEIPTS), "10 minutes")
        assert as_set(counts) == as_set(expected)


def test_a_late_count_is_passed_on_without_a_rate(spark, tmp_path):
    schema = "slot_start timestamp, topology_key string, source_task int, destination_task int, tuples long"
    rows = [(DAY0 + dt.timedelta(minutes=m), "x", 0, 1, n) for m, n in ((0, 4), (20, 8), (10, 99), (30, 6))]
    source = feed(spark, tmp_path, schema, [rows[:2], rows[2:]])
    got = landed(spark, stats.stream_moving_rate(source, 2, 2), tmp_path, "late-rates")
    assert {((r.slot_start - DAY0).seconds // 60, r.rate) for r in got.collect()} == {(0, 2), (20, 3), (10, None), (30, 3)}


def test_a_marker_closes_the_last_snapshot(spark, tmp_path):
    schema = "ts timestamp, cluster string, host string, port int, executor string"
    rows = [(DAY0 + dt.timedelta(days=d), "c", "a", 1, "xyy"[d]) for d in range(3)]
    source = feed(spark, tmp_path, schema, [rows])
    append_end_marker(spark, f"{tmp_path}/in", source.schema, rows[-1][0], "1 day", "1 hour")
    marks = landed(spark, decisions.stream_fingerprints(source, "1 day", "1 hour"), tmp_path, "all-marks")
    assert {r.snapshot for r in marks.collect()} == {r[0] for r in rows}


def test_a_placement_that_vanishes_and_returns_is_a_change(spark, tmp_path):
    """Day 2 has no rows: nothing was assigned then."""
    schema = "ts timestamp, cluster string, host string, port int, executor string"
    rows = [(DAY0 + dt.timedelta(days=d, hours=h), "c", "a", 1, e) for d in (0, 1, 3, 4) for h, e in enumerate("xyx")]
    for batch in (rows[:6], rows[6:]):
        source = feed(spark, tmp_path, schema, [batch])
        append_end_marker(spark, f"{tmp_path}/in", source.schema, batch[-1][0], "1 day", "1 hour")
        marks = landed(spark, decisions.stream_fingerprints(source, "1 day", "1 hour"), tmp_path, "gap-marks")
        stream = relay(spark, marks, tmp_path, "gap-marks")
        got = landed(spark, decisions.stream_assignment_changes(stream, "1 day"), tmp_path, "gap-changes")
    days = spark.createDataFrame([(DAY0 + dt.timedelta(days=d),) for d in range(5)], "ts timestamp").selectExpr(
        "to_date(ts) snapshot"
    )
    batch_rows = spark.createDataFrame(rows, schema).withColumn("snapshot", F.to_date("ts"))
    expected = as_set(history.assignment_changes(batch_rows, days))
    assert {(r.snapshot.date(),) for r in got.collect()} == expected == {(DAY0.date(),), ((DAY0 + dt.timedelta(days=3)).date(),)}
    # one digest for both forms
    live = {(r.snapshot.date(), r.fingerprint) for r in marks.collect()}
    assert live == as_set(history.fingerprints(batch_rows))


def test_digests_tell_sets_apart(spark):
    schema = "snapshot int, host string, port int, executor string"
    sets = [[("a", 1, "x")], [("a", 1, "y")], [("a", 1, "x"), ("a", 1, "y")], [("a", 2, "x")], [("b", 1, "x")],
            [("a", 1, None)], [("a", None, "x")]]
    rows = [(k, *r) for k, group in enumerate(sets) for r in group * 2]
    marks = history.fingerprints(spark.createDataFrame(rows, schema)).collect()
    assert len({m.fingerprint for m in marks}) == len(sets) == len(marks)
    plan = history.fingerprints(spark.createDataFrame(rows, schema))._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in plan
