from __future__ import annotations

import datetime as dt
import random

from conftest import as_set
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowscope.operators import cooldown, series
from flowscope.operators.rollup import executor_ranges

DAY0 = dt.datetime(2024, 1, 1)

samples = st.lists(
    st.tuples(st.integers(1, 2), st.integers(0, 6 * 24), st.integers(0, 1000)),
    min_size=1,
    max_size=60,
    unique_by=lambda s: s[:2],
)


def frame(spark, data, value="v"):
    rows = [(k, DAY0 + dt.timedelta(hours=h), i, v) for i, (k, h, v) in enumerate(data)]
    return spark.createDataFrame(rows, f"thread_id long, ts timestamp, event_id long, {value} long")


def in_order(data):
    for key in {k for k, *_ in data}:
        yield sorted((h, i, v) for i, (k, h, v) in enumerate(data) if k == key)


@settings(max_examples=5, deadline=None)
@given(samples, st.integers(1, 5))
def test_moving_rate_across_pieces(spark, data, n):
    got = series.moving_rate(frame(spark, data), ["thread_id"], ["ts", "event_id"], "v", n, 7)
    rates = {r.event_id: r.rate for r in got.collect()}
    for ordered in in_order(data):
        for at, (_, i, _v) in enumerate(ordered):
            window = [v for *_, v in ordered[max(0, at - n + 1) : at + 1]]
            assert rates[i] == sum(window) // (len(window) * 7)


@settings(max_examples=5, deadline=None)
@given(samples)
def test_counter_delta_across_pieces(spark, data):
    """First sample in full, resets in full, negative samples dropped."""
    data = [(k, h, v - 100) for k, h, v in data]
    got = series.counter_delta(frame(spark, data, "cpu_total"), 10**9)
    cycles = {r.event_id: r.cycles for r in got.collect()}
    expected = {}
    for ordered in in_order(data):
        previous = 0
        for _, i, v in ordered:
            if v >= 0:
                delta = v if v < previous else v - previous
                expected[i] = int(delta / 1e9 * 1e9)
                previous = v
    assert cycles == expected


@settings(max_examples=4, deadline=None)
@given(samples)
def test_running_sum_and_latest(spark, data):
    df = frame(spark, data)
    summed = series.running_sum(df, ["thread_id"], ["ts", "event_id"], F.col("v"), series.day_of("ts"), "s")
    got = {r.event_id: r.s for r in summed.collect()}
    last = {}
    for ordered in in_order(data):
        total = 0
        for _, i, v in ordered:
            total += v
            assert got[i] == total
        last[data[ordered[-1][1]][0]] = ordered[-1][2]
    newest = series.latest_sample(df, ["thread_id"], ["ts", "event_id"], ["v"])
    assert as_set(newest) == set(last.items())


def test_one_hot_thread_is_cut_into_pieces(spark):
    """The sample window is partitioned by (thread, piece), never by thread alone."""
    plan = series.counter_delta(frame(spark, [(1, 1, 1)], "cpu_total"), 1)._jdf.queryExecution().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "cpu_total" in line]
    assert windows and all("__piece" in line.split("windowspecdefinition(")[1] for line in windows)


def test_host_usage_truncates(rows):
    cycles = rows(
        "thread_id long, ts timestamp, event_id long, cycles long",
        [(1, DAY0, 1, 1), (1, DAY0 + dt.timedelta(1), 2, 999), (2, DAY0, 3, 1001)],
    )
    hosts = rows("host string, cores int, total_hz long", [("h", 1, 1000)])
    threads = rows("thread_id long, host string", [(1, "h"), (2, "h")])
    got = series.host_usage_pct(cycles, threads, hosts, 2)
    assert as_set(got) == {("h", 499 + 500, 1000, 99)}


def test_executor_range_of_a_thread(rows):
    seen = rows("thread_id long, task_id int", [(1, 4), (1, 2), (1, 3), (2, 9)])
    assert as_set(executor_ranges(seen)) == {(1, 2, 4), (2, 9, 9)}


EVALS = "topology_key string, eval_ts timestamp, event_id long, wanted boolean, timeout_s int"


def expected_fires(data):
    fires = set()
    for key in {k for k, *_ in data}:
        last = None
        for ts, i, timeout in sorted((t, i, o) for k, t, i, w, o in data if k == key and w):
            if last is None or (ts - last).total_seconds() >= timeout:
                last = ts
                fires.add((key, i))
    return fires


def test_cooldown_equals_the_sequential_rule(spark):
    rng = random.Random(7)
    for timeout, gap, piece in ((60, 40, 120), (60, 900, 7), (1, 1, 5), (100, 3, 100)):
        data, clock = [], DAY0
        for i in range(400):
            clock += dt.timedelta(milliseconds=rng.randrange(gap * 1000))
            data.append((rng.choice("ab"), clock, i, rng.random() < 0.8, rng.choice([timeout, 3 * timeout, timeout // 2])))
        fired = cooldown.cooldown_alerts(spark.createDataFrame(data, EVALS), piece)
        assert as_set(fired, "topology_key", "event_id") == expected_fires(data)


def test_cooldown_boundary(rows):
    at = [0, 179.999, 180, 359.999, 360.001]
    data = [("a", DAY0 + dt.timedelta(seconds=s), i, True, 180) for i, s in enumerate(at)]
    fired = cooldown.cooldown_alerts(rows(EVALS, data))
    assert as_set(fired, "event_id") == {(0,), (2,), (4,)}


def test_each_evaluation_waits_for_its_own_timeout(rows):
    timeouts = [10, 20, 10, 5]
    data = [("a", DAY0 + dt.timedelta(seconds=10 * i), i, True, t) for i, t in enumerate(timeouts)]
    assert as_set(cooldown.cooldown_alerts(rows(EVALS, data)), "event_id") == {(0,), (2,), (3,)}
