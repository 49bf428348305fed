from __future__ import annotations

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowscope.functions import params as P
from flowscope.functions import text as X
from flowscope.sources.cpuinfo import host_cpu_totals, parse_cpuinfo, read_cpuinfo


def one(df):
    return df.collect()[0]


def test_float_product_for_alfa_and_double_product_for_delta(rows):
    """ceil(0.1f * 10) is 1 in floats and 2 in doubles."""
    df = rows("executors int, slots int, alfa float, delta float", [(11, 1, 0.1, 0.1)])
    # One slot takes everything whatever alfa is.
    df2 = rows("executors int, slots int, alfa float", [(24, 3, 0.1)])
    assert one(df.select(P.max_executors_per_slot("executors", "slots", "alfa").alias("m"))).m == 11
    lo, hi = 8, 22
    expected = lo + math.ceil(float(np.float32(0.1) * np.float32(hi - lo)))
    assert one(df2.select(P.max_executors_per_slot("executors", "slots", "alfa").alias("m"))).m == expected
    # beta 0 uses the lower bound, here one node per slot.
    d = rows("n int, s int, beta float, delta float", [(1, 11, 0.0, 0.1)])
    got = one(
        d.select(
            P.nodes_to_use("n", "s", "beta").alias("u"),
            P.max_slots_per_node("n", "s", "beta", "delta").alias("m"),
        )
    )
    use = 11
    assert got.u == use
    assert got.m == 1 + math.ceil(float(np.float32(0.1)) * (11 - use + 1 - 1))


@settings(max_examples=5, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.integers(1, 60), st.integers(1, 40), st.integers(1, 30), st.integers(0, 100), st.integers(0, 10**12)
        ),
        min_size=20,
        max_size=60,
    )
)
def test_limits_match_scalar_arithmetic(spark, cases):
    data = [(w, e, n, a / 100, t) for w, e, n, a, t in cases]
    df = spark.createDataFrame(data, "w int, e int, n int, share float, total long")
    got = df.select(
        "*",
        P.slot_count("w", "e").alias("slots"),
    ).select(
        "*",
        P.max_executors_per_slot("e", "slots", "share").alias("per_slot"),
        P.nodes_to_use("n", "slots", "share").alias("use"),
        P.max_slots_per_node("n", "slots", "share", "share").alias("per_node"),
        P.max_load_per_slot("total", "slots", F.col("share") + 1).alias("max_load"),
        P.traffic_threshold("total", "e").alias("threshold"),
    )
    f32 = np.float32
    for r in got.collect():
        slots = min(r.w, r.e)
        assert r.slots == slots
        lo, hi = math.ceil(r.e / slots), r.e - slots + 1
        assert r.per_slot == lo + math.ceil(f32(r.share) * f32(hi - lo))
        n = min(r.n, slots)
        lo = math.ceil(slots / n)
        use = lo + math.ceil(f32(r.share) * f32(n - lo))
        assert r.use == use
        lo, hi = math.ceil(slots / use), slots - use + 1
        assert r.per_node == lo + math.ceil(float(f32(r.share)) * (hi - lo))
        gamma = f32(float(f32(r.share)) + 1)
        assert r.max_load == int(gamma * f32(r.total // slots))
        assert r.threshold == int(f32(r.total) * (f32(1) - f32(r.e) / f32(100)))


def test_params_are_parsed_defaulted_and_checked(rows):
    conf = [
        (1, {"alfa": "0.5", "gamma": "1.5", "traffic.improvement": "20", "reschedule.timeout": "60"}),
        (2, {}),
        (3, {"alfa": "1.5", "beta": "-0.1", "gamma": "0.9", "delta": "2", "traffic.improvement": "101"}),
    ]
    typed = P.default_params(P.parse_params(rows("id int, conf map<string,string>", conf)))
    got = {r.id: r for r in typed.collect()}
    assert (got[1].alfa, got[1].beta, got[1].gamma, got[1].delta) == (0.5, 1.0, 1.5, 0.0)
    assert (got[1].improvement, got[1].timeout_s, got[1].epsilon) == (20, 60, 0.5)
    assert (got[2].alfa, got[2].gamma, got[2].timeout_s) == (0.0, None, 180)
    broken = {r.id: r.broken for r in P.validate_params(typed).collect()}
    assert broken == {2: ["improvement"], 3: ["alfa", "beta", "delta", "gamma", "improvement"]}


def test_text_rendering(rows):
    df = rows(
        "l array<int>, m map<string,array<int>>",
        [(None, None), ([], {}), ([3, 1], {"b": [2], "a": []})],
    )
    got = [tuple(r) for r in df.select(X.list_to_csv("l"), X.map_to_text("m")).collect()]
    assert got == [
        ("null", "null"),
        ("<empty list>", "<empty map>"),
        ("3, 1", "a -> (<empty list>), b -> (2)"),
    ]
    line = rows("s string", [("cpu MHz\t\t: 1: 2 ",), ("no colon",)])
    assert [tuple(r) for r in line.select(X.key_of("s"), X.value_of("s")).collect()] == [
        ("cpu MHz", "1: 2"),
        (None, None),
    ]


def test_cpuinfo_files(spark, tmp_path):
    body = (
        "processor\t: 0\nmodel name\t: Fast: 1\ncpu MHz\t\t: 1001.937\n\n"
        "processor\t: 1\nflags\t\t: a b\ncpu MHz\t\t: 2000.5\nmodel name\t: Slow\n"
    )
    for host in ("h1", "h2"):
        (tmp_path / host).mkdir()
        (tmp_path / host / "cpuinfo").write_text(body)
    cores = parse_cpuinfo(read_cpuinfo(spark, str(tmp_path)))
    assert {tuple(r) for r in cores.filter("host = 'h1'").collect()} == {
        ("h1", 0, "Fast: 1", 1001 * 1024 * 1024),
        ("h1", 1, "Slow", 2000 * 1024 * 1024),
    }
    totals = {tuple(r) for r in host_cpu_totals(cores).collect()}
    assert totals == {(h, 2, 3001 * 1024 * 1024) for h in ("h1", "h2")}
