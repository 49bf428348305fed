from __future__ import annotations

import math
import random

import numpy as np
from conftest import as_set

from flowscope.operators import choose, placement

STATE = "topology_id int, slot_id int, executors int, load long, max_executors int, max_load long"
PORTS = "name string, port int, used boolean"
NODES = "name string, capacity long, slots int, load long, ports int, free_ports int"


def test_least_loaded_slot_equals_brute_force(spark):
    rng = random.Random(3)
    limits = {1: (6, 40), 2: (4, None), 3: (5, -1), 4: (3, 10)}
    slots = [
        (t, s, rng.randrange(0, cap + 1), rng.randrange(0, 50), cap, top)
        for t, (cap, top) in limits.items()
        for s in range(7)
    ]
    asked = [(i, rng.randrange(1, 6), rng.randrange(0, 4) + 1, rng.randrange(0, 30)) for i in range(200)]
    got = choose.least_loaded_slot(
        spark.createDataFrame(asked, "id int, topology_id int, k int, x long"),
        spark.createDataFrame(slots, STATE),
    )
    picks = {r.id: r.slot_id for r in got.collect()}
    for i, t, k, x in asked:
        able = [
            (load, s)
            for tt, s, n, load, cap, top in slots
            if tt == t and cap - n >= k and (top is None or top < 0 or load + x <= top)
        ]
        assert picks[i] == (min(able)[1] if able else None)


def test_least_loaded_node_equals_brute_force(spark):
    rng = random.Random(5)
    nodes = [
        (f"n{i:02}", rng.randrange(20, 100), 0, rng.randrange(0, 90), 0, rng.randrange(-1, 4)) for i in range(30)
    ]
    on_node = {(f"n{i:02}", t): rng.randrange(1, 4) for i in range(30) for t in (1, 2) if rng.random() < 0.4}
    limits = {1: 3, 2: 2, 3: 1}
    banned = {(t, f"n{i:02}") for t in (1, 3) for i in range(30) if rng.random() < 0.3}
    asked = [(i, rng.randrange(1, 4), rng.randrange(1, 3), rng.randrange(0, 60)) for i in range(150)]
    got = choose.least_loaded_node(
        spark.createDataFrame(asked, "id int, topology_id int, k int, x long"),
        spark.createDataFrame(nodes, NODES),
        spark.createDataFrame([(n, t, c) for (n, t), c in on_node.items()], "node string, topology_id int, slots int"),
        spark.createDataFrame(list(limits.items()), "topology_id int, max_slots int"),
        spark.createDataFrame(list(banned), "topology_id int, node string"),
    )
    picks = {r.id: r.node for r in got.collect()}
    for i, t, k, x in asked:
        able = [
            (load, n)
            for n, cap, _, load, _, free in nodes
            if free >= k
            and load + x <= cap
            and on_node.get((n, t), 0) + k <= limits[t]
            and (t, n) not in banned
        ]
        assert picks[i] == (min(able)[1] if able else None)


def deal(free, k, beta):
    """Take one port per chosen host in turn, skipping exhausted hosts."""
    order = sorted(free, key=lambda h: (-len(free[h]), h))
    total, lo = 0, 0
    while total < k:
        total += len(free[order[lo]])
        lo += 1
    hi = min(len(order), k)
    use = lo + math.ceil(np.float32(beta) * np.float32(hi - lo))
    queues, out, at = {h: sorted(free[h]) for h in order}, [], 0
    for slot in range(k):
        while not queues[order[at]]:
            at = (at + 1) % use
        out.append((slot, order[at], queues[order[at]].pop(0)))
        at = (at + 1) % use
    return (lo, hi, use), out


def test_round_robin_equals_the_loop(spark):
    rng = random.Random(11)
    for beta in (0.0, 0.4, 1.0):
        free = {f"h{i}": sorted(rng.sample(range(20), rng.randrange(1, 6))) for i in range(rng.randrange(2, 8))}
        k = rng.randrange(1, sum(map(len, free.values())) + 1)
        used = [("h0", 99, True), ("full", 1, True)]
        ports = spark.createDataFrame([(h, p, False) for h, ps in free.items() for p in ps] + used, PORTS)
        needed, expected = deal(free, k, beta)
        assert as_set(choose.min_nodes_needed(ports, k, beta)) == {needed}
        assert as_set(choose.round_robin_deal(ports, k, beta)) == set(expected)


def test_too_few_ports_give_no_answer(rows):
    ports = rows(PORTS, [("a", 1, False), ("a", 2, True)])
    assert as_set(choose.min_nodes_needed(ports, 2)) == set()
    assert as_set(choose.round_robin_deal(ports, 2)) == set()


def test_hosts_by_free_ports_in_order(rows):
    ports = rows(PORTS, [("b", 1, False), ("a", 1, False), ("c", 1, False), ("c", 2, False), ("c", 2, False)])
    got = [tuple(r) for r in choose.hosts_by_free_ports(ports).select("name", "free_ports").collect()]
    assert got == [("c", 2), ("a", 1), ("b", 1)]


def test_ports_are_a_union(rows):
    node = rows("name string, capacity long, cores int", [("a", 1, 1), ("silent", 1, 1)])
    ports = rows(PORTS, [("a", 1, False), ("a", 1, True), ("a", 2, True)])
    assert as_set(placement.ports_per_host(node, ports)) == {("a", 2), ("silent", 0)}


def test_node_feasibility(rows):
    nodes = rows(NODES, [("a", 10, 1, 5, 2, 1), ("full", 99, 1, 0, 1, 0), ("b", 10, 0, 6, 1, 1)])
    slot_node = rows("topology_id int, slot_id int, node string", [(1, 0, "a")])
    on_node = rows("node string, topology_id int, slots int", [("a", 1, 1)])
    limits = rows("topology_id int, max_slots int", [(1, 2), (2, 1)])
    candidates = rows(
        "topology_id int, slot_id int, node string, load long",
        [(1, 0, "a", 1), (1, 1, "a", 5), (1, 1, "a", 6), (1, 1, "full", 1), (2, 0, "b", 4), (2, 0, "b", 5)],
    )
    got = placement.can_assign_node(candidates, nodes, slot_node, on_node, limits)
    assert as_set(got.filter("can_assign"), "topology_id", "slot_id", "node", "load") == {
        (1, 1, "a", 5),
        (2, 0, "b", 4),
    }
    black = rows("topology_id int, node string", [(2, "b")])
    left = placement.can_assign_node(candidates, nodes, slot_node, on_node, limits, black)
    assert left.filter("node = 'b'").count() == 0


def test_upstream_slots(rows):
    dag = rows(
        "topology_id int, components array<string>, streams map<string,array<string>>",
        [(1, ["s", "m", "t"], {"m": ["s"], "t": ["m"]})],
    )
    placed = rows(
        "topology_id int, begin_task int, end_task int, load long, slot_id int, component string",
        [(1, 1, 1, 1, 0, "s"), (1, 2, 2, 1, 0, "s"), (1, 3, 3, 1, 1, "m")],
    )
    state = rows(STATE, [(1, 0, 2, 0, 2, None), (1, 1, 1, 0, 2, None), (1, 2, 0, 0, 2, None)])
    got = placement.upstream_slots(dag, placed, state, 0.5)
    assert as_set(got, "component", "slot_id", "slot_class", "promoted") == {
        ("s", 1, "secondary", False),
        ("s", 2, "secondary", False),
        ("m", 1, "secondary", False),
        ("m", 2, "primary", True),
        ("t", 1, "primary", False),
        ("t", 2, "primary", True),
    }
