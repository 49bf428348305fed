"""Pair placements against plain recomputation, with both, one or no end placed."""

from __future__ import annotations

import random
import re

import pytest
from flowscope.operators import pairing

PAIRS = "topology_id int, src_begin int, src_end int, dst_begin int, dst_end int, traffic long"
PLACED = "topology_id int, begin_task int, end_task int, load long, slot_id int"
STATE = "topology_id int, slot_id int, executors int, load long, max_executors int, max_load long"
UNITS, SLOTS = 10, 4


def cut(weight, where):
    return sum(w for (a, b), w in weight.items() if None not in (where[a], where[b]) and where[a] != where[b])


def pick(held, places, limit, k, x, not_on=None):
    able = [(load, s) for s, (n, load) in held.items() if s != not_on and n + k <= places and (limit is None or load + x <= limit)]
    return min(able)[1] if able else None


def expected(weight, loads, slots, held, places, limit):
    """(first, second) -> {(slot, slot): (cut, feasible)}"""
    out = {}
    for e, g in {(min(a, b), max(a, b)) for a, b in weight if a != b}:
        if slots[e] is None and slots[g] is None:
            both = pick(held, places, limit, 2, loads[e] + loads[g])
            if both is not None:
                ways = [(both, both)]
            else:
                # whatever the load, so that what does not fit can be told
                one = pick(held, places, None, 1, 0)
                two = pick(held, places, None, 1, 0, not_on=one)
                ways = [(one, two)] if None not in (one, two) else []
        else:
            offered = {slots[e], slots[g], pick(held, places, limit, 1, max(loads[e], loads[g]))} - {None}
            ways = [(a, b) for a in offered for b in offered]
        found = {}
        for a, b in ways:
            where = list(slots)
            where[e], where[g] = a, b
            fits = True
            for s in {a, b}:
                inside = [x for x in range(UNITS) if where[x] == s]
                fits &= len(inside) <= places and (limit is None or sum(loads[x] for x in inside) <= limit)
            found[a, b] = (cut(weight, where), fits)
        out[e, g] = found or {(None, None): (None, False)}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_equals_recomputation(spark, seed):
    rng = random.Random(seed)
    weight = {}
    for _ in range(25):
        a, b = rng.randrange(UNITS), rng.randrange(UNITS)
        weight[a, b] = weight.get((a, b), 0) + rng.randrange(1, 9)
    loads = [3 + e for e in range(UNITS)]
    slots = [rng.choice([None, None, 0, 1, 2]) for _ in range(UNITS)]
    # from roomy to so tight that nothing fits
    places, limit = rng.choice([(9, None), (3, 30), (2, 25), (1, 12), (4, 20)])
    held = {s: (slots.count(s), sum(loads[x] for x in range(UNITS) if slots[x] == s)) for s in range(SLOTS)}
    pairs = spark.createDataFrame([(1, a, a, b, b, w) for (a, b), w in weight.items()], PAIRS)
    state = spark.createDataFrame([(1, s, *held[s], places, limit) for s in range(SLOTS)], STATE)
    rows = [(1, e, e, loads[e], s) for e, s in enumerate(slots)]
    want = expected(weight, loads, slots, held, places, limit)

    # unplaced executors without a slot, or in a table of their own
    whole = spark.createDataFrame(rows, PLACED)
    for placement, executors in [(whole, None), (whole.filter("slot_id is not null"), whole.drop("slot_id"))][seed % 2 :][:1]:
        got: dict = {}
        for r in pairing.score_pair_placements(pairs, placement, state, executors).collect():
            got.setdefault((r.first_begin, r.second_begin), {})[r.first_slot, r.second_slot] = (r.cut, r.feasible)
        assert got == want
        best = {
            (r.first_begin, r.second_begin): (r.cut, r.first_slot, r.second_slot)
            for r in pairing.best_pair_placement(pairs, placement, state, executors).collect()
        }
        for pair, ways in want.items():
            able = [(c, a, b) for (a, b), (c, ok) in ways.items() if ok]
            assert best[pair] == (min(able) if able else (None, None, None))
        assert best.keys() == want.keys()


def test_units_without_any_row(spark):
    pairs = spark.createDataFrame([(1, 0, 0, 5, 5, 7), (2, 0, 0, 1, 1, 3)], PAIRS)
    placement = spark.createDataFrame([(1, 0, 0, 4, 0)], PLACED)
    state = spark.createDataFrame([(1, 0, 1, 4, 2, 9), (1, 1, 0, 0, 2, 9)], STATE)
    got = pairing.best_pair_placement(pairs, placement, state).collect()
    by = {(r.topology_id, r.first_begin, r.second_begin): (r.first_slot, r.second_slot, r.cut) for r in got}
    assert by == {(1, 0, 5): (0, 0, 0), (2, 0, 1): (None, None, None)}


def test_few_exchanges_of_pairs(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = spark.createDataFrame([(1, 0, 0, 1, 1, 7)], PAIRS)
        placement = spark.createDataFrame([(1, 0, 0, 4, 0), (1, 1, 1, 4, None)], PLACED)
        state = spark.createDataFrame([(1, 0, 1, 4, 2, 9)], STATE)
        plan = pairing.best_pair_placement(pairs, placement, state)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One to sum up both directions and one a join; the other side of each is units or affinities.
    # Four joins of two sides, the pairs being one, after one exchange that sums up both directions.
    assert len(re.findall(r"Exchange hashpartitioning\(topology_id#\d+, (?:first|second)#", plan)) == 2 * 4
    assert len(re.findall(r"Exchange hashpartitioning\(topology_id#\d+, _groupingexpression", plan)) == 1
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pairs_are_short_while_they_are_dealt_out(spark):
    """Facts of a topology never lie beside a pair in an exchange, those of a unit in the last one only."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1MB")
    try:
        pairs = spark.createDataFrame([(1, 0, 0, 1, 1, 7)], PAIRS)
        placement = spark.createDataFrame([(1, 0, 0, 4, 0), (1, 1, 1, 4, None)], PLACED)
        state = spark.createDataFrame([(1, 0, 1, 4, 2, 9)], STATE)
        for operator in (pairing.score_pair_placements, pairing.best_pair_placement):
            plan = operator(pairs, placement, state)._jdf.queryExecution().explainString(
                spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
            )
            dealt = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
            both = sorted((x.count(", ") + 1 for x in dealt if "first#" in x and "second#" in x), reverse=True)
            assert len(both) == 4 and both[0] <= 16 and both[1] <= 8, both
            assert not any(re.search(r"\b(single|double|next|limit|cut)", x) for x in dealt if "second#" in x)
            assert "BroadcastHashJoin LeftOuter BuildRight" in plan  # topologies are few; pairs stay where they are
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_copies_repeated_units_and_torn_keys(spark, monkeypatch):
    """One executor with many partners, one listed twice, one without an end."""
    weight = [(1, 0, 0, b, b, 1 + b % 3) for b in range(1, 40)] + [(1, 3, 3, 50, None, 2), (1, 4, 4, 3, 3, 5)]
    rows = [(1, b, b, 2, b % 3 if b % 4 else None) for b in range(40)] + [(1, 5, 5, 2, 2), (1, 50, None, 1, 1)]
    pairs, placement = spark.createDataFrame(weight, PAIRS), spark.createDataFrame(rows, PLACED)
    state = spark.createDataFrame([(1, s, 9, 20 + s, 30, 90) for s in range(3)], STATE)

    def result():
        return sorted(map(str, pairing.best_pair_placement(pairs, placement, state).collect()))

    few = result()
    monkeypatch.setattr(pairing, "PAIRS_A_COPY", 3)
    assert result() == few
    # A pair has a row for each time a unit is listed; the one without an end also counts as unknown.
    assert len(few) == (39 + 1) + 2 + 1
    assert all("first_slot=None" not in r for r in few)
