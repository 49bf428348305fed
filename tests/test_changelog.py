"""Compacted change logs equal the plain log, read base and tail only, and keep versions apart."""

from __future__ import annotations

import random

from conftest import as_set
from pyspark.sql import types as T

from flowscope.sources.changelog import ChangeLog
from flowscope.sources.latest import latest
from flowscope.streaming.sources import read_files
from flowscope.streaming.stats import store_changes

SCHEMA = T.StructType([T.StructField(c, T.IntegerType()) for c in ("topology_id", "task", "load", "at")])
KEYS = ("topology_id", "task")


def make(spark, path):
    return ChangeLog(spark, f"{path}/log", SCHEMA, KEYS, ("at",), parts=4)


def folders(df):
    return {f.split("/log/")[1].rsplit("/", 1)[0] for f in df.inputFiles()}


def test_compaction_changes_no_value(spark, tmp_path):
    rng, log, rows = random.Random(3), make(spark, tmp_path), []
    assert log.current().collect() == [] and log.compact() == 0
    for k in range(6):
        batch = [(rng.randrange(3), rng.randrange(6), rng.randrange(99), 10 * k + i) for i in range(8)]
        rows += batch
        log.append(spark.createDataFrame(batch, SCHEMA), f"b{k}")
        log.append(spark.createDataFrame(batch, SCHEMA), f"b{k}")  # run again
        expected = as_set(latest(spark.createDataFrame(rows, SCHEMA), KEYS, ["at"]))
        assert as_set(log.current()) == expected
        if k in (1, 2, 4):
            assert log.compact() == log.manifest()["version"]
            assert as_set(log.current()) == expected
            assert log.log().count() == len(expected)  # one row a key
    assert log.manifest()["version"] == 3
    assert {f for f in folders(log.log()) if f.startswith("tail")} == {"tail/b5"}
    log.append(spark.createDataFrame([(0, 0, -1, -1)], SCHEMA), "b0")  # a folded batch comes again
    assert as_set(log.current()) == expected


def test_only_touched_parts_are_written_anew(spark, tmp_path):
    log = make(spark, tmp_path)
    log.append(spark.createDataFrame([(1, t, 1, 1) for t in range(40)], SCHEMA), "first")
    log.compact()
    before = log.manifest()["parts"]
    log.append(spark.createDataFrame([(1, 7, 2, 2)], SCHEMA), "second")
    log.compact()
    after = log.manifest()["parts"]
    assert len(before) == 4 and sum(before[p] != after[p] for p in before) == 1
    assert as_set(log.current().filter("load = 2"), "task") == {(7,)} and log.current().count() == 40


def test_a_reader_keeps_its_version(spark, tmp_path):
    log = make(spark, tmp_path)
    log.append(spark.createDataFrame([(1, t, 1, 1) for t in range(9)], SCHEMA), "a")
    log.compact()
    reader = log.current()
    log.append(spark.createDataFrame([(1, t, 2, 2) for t in range(9)], SCHEMA), "b")
    log.compact()
    log.vacuum(keep=2)
    assert as_set(reader, "load") == {(1,)} and as_set(log.current(), "load") == {(2,)}
    log.vacuum(keep=1)
    assert as_set(log.current(), "load") == {(2,)}
    kept = folders(log.log())
    assert all(f.startswith("base/") for f in kept) and len({f.split("/")[1] for f in kept}) == 1
    assert not log._names("tail") and len(log._versions()) == 1


def test_an_incomplete_batch_does_not_count(spark, tmp_path):
    log = make(spark, tmp_path)
    log.append(spark.createDataFrame([(1, 1, 1, 1)], SCHEMA), "whole")
    spark.createDataFrame([(1, 1, 9, 9)], SCHEMA).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).parquet(f"{tmp_path}/log/tail/part")
    assert as_set(log.current(), "load") == {(1,)}


def test_a_stream_compacts_its_log(spark, tmp_path):
    log, rows = make(spark, tmp_path), []
    for k in range(5):
        batch = [(1, t, k, k) for t in range(k + 1)]
        rows += batch
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = read_files(spark, f"{tmp_path}/in", SCHEMA, max_files=1)
        store_changes(source, log, f"{tmp_path}/checkpoint", compact_every=2).awaitTermination()
    assert as_set(log.current()) == as_set(latest(spark.createDataFrame(rows, SCHEMA), KEYS, ["at"]))
    assert log.manifest()["version"] == 2
