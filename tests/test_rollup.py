from __future__ import annotations

from conftest import as_set
from hypothesis import given, settings
from hypothesis import strategies as st

from flowscope.operators import choose, resolve, pairing, rollup, whatif
from flowscope.operators.numbering import hierarchical_rank, number_keys

LOAD = "topology_id int, begin_task int, end_task int, load long, node string"
TRAFFIC = "topology_id int, source_task int, destination_task int, traffic int"
NODE = "name string, capacity long, cores int"
PLACED = "topology_id int, begin_task int, end_task int, load long, slot_id int"


def test_an_unmatched_task_empties_its_topology_only(rows):
    load = rows(LOAD, [(1, 1, 2, 5, "n"), (1, 3, 4, 5, "m"), (2, 1, 2, 5, "n"), (2, 3, 4, 5, "m")])
    traffic = rows(TRAFFIC, [(1, 1, 3, 7), (1, 9, 3, 1), (2, 1, 3, 4)])
    assert as_set(rollup.executor_traffic(traffic, load)) == {(2, 1, 2, 3, 4, 4)}
    assert as_set(rollup.complete_topologies(traffic, load)) == {(2,)}
    assert as_set(rollup.inter_node_traffic(traffic, load)) == {(11,)}


def test_self_pairs_and_directions(rows):
    load = rows(LOAD, [(1, 1, 2, 5, "n"), (1, 3, 4, 5, "n")])
    traffic = rows(TRAFFIC, [(1, 1, 2, 9), (1, 1, 3, 3), (1, 4, 2, 4)])
    pairs = rollup.executor_traffic(traffic, load)
    assert as_set(pairs) == {(1, 1, 2, 1, 2, 9), (1, 1, 2, 3, 4, 3), (1, 3, 4, 1, 2, 4)}
    placement = rows(PLACED, [(1, 1, 2, 5, 0), (1, 3, 4, 5, 1)])
    slots = rollup.slot_traffic(pairs, placement)
    assert as_set(slots) == {(1, 0, 1, 7)}
    listed = rollup.executor_adjacency(pairs).select("begin_task", "degree", "traffic")
    assert as_set(listed) == {(1, 3, 16), (3, 2, 7)}
    one_node = rows("topology_id int, slot_id int, node string", [(1, 0, "n"), (1, 1, "n")])
    nodes = rollup.node_traffic(slots, one_node)
    assert as_set(rollup.node_traffic_total(nodes, one_node)) == {(0,)}
    assert as_set(rollup.node_traffic_total(nodes, one_node.limit(0))) == {(None,)}


def test_adjacency_pages_hold_the_whole_list(rows):
    pairs = rows(
        "topology_id int, src_begin int, src_end int, dst_begin int, dst_end int, traffic long",
        [(1, 0, 0, i, i, i) for i in range(1, 100)],
    )
    paged = rollup.executor_adjacency(pairs, page=10).filter("begin_task = 0")
    got = [(r.page, r.degree, len(r.edges)) for r in paged.collect()]
    assert len(got) == 10 and sum(d for _, d, _ in got) == 99
    assert all(d == n <= 10 for _, d, n in got)


def test_load_equal_to_capacity_is_not_overload(rows):
    load = rows(LOAD, [(1, 1, 1, 5, "a"), (1, 2, 2, 5, "a"), (1, 3, 3, 9, "b"), (1, 4, 4, 9, "lost")])
    node = rows(NODE, [("a", 10, 1), ("b", 8, 1), ("idle", 1, 1)])
    assert as_set(rollup.overloaded_nodes(load, node), "name") == {("b",)}
    assert as_set(rollup.node_load(load, node), "name") == {("a",), ("b",)}


def test_topology_without_load_reports_zero(rows):
    topology = rows("topology_id int, topology_key string", [(1, "x"), (2, "y")])
    load = rows(LOAD, [(1, 1, 1, 5, "a")])
    assert as_set(rollup.total_load(load, topology)) == {(1, "x", 5), (2, "y", 0)}


def test_overlapping_and_wide_ranges(rows):
    load = rows(
        "topology_id int, begin_task int, end_task int", [(1, 5, 9), (1, 1, 6), (2, 0, 5000)]
    )
    tasks = rows("topology_id int, task int", [(1, 5), (1, 9), (1, 10), (2, 1023), (2, 1024), (2, 5000)])
    assert as_set(resolve.resolve_tasks(tasks, load)) == {
        (1, 5, 1, 6),
        (1, 9, 5, 9),
        (1, 10, None, None),
        (2, 1023, 0, 5000),
        (2, 1024, 0, 5000),
        (2, 5000, 0, 5000),
    }


def test_numbering_is_dense_and_stable(rows):
    keys = rows("k string", [(f"key{i}",) for i in range(500)] * 2)
    got = as_set(number_keys(keys, "k"))
    assert {i for i, _ in got} == set(range(1, 501)) and len(got) == 500
    assert got == as_set(number_keys(keys.repartition(3), "k"))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 5), st.integers(0, 4)), min_size=1, max_size=60))
def test_hierarchical_rank_is_row_number(spark, data):
    data = [(p, v, a, i) for i, (p, v, a) in enumerate(data)]
    df = spark.createDataFrame(data, "p int, v int, a int, id int")
    ranked = hierarchical_rank(df, ["p"], [("v", False), ("a", True)], ["id"])
    got = {r.id: r.position for r in ranked.collect()}
    for part in {p for p, *_ in data}:
        order = sorted((-v, a, i) for p, v, a, i in data if p == part)
        assert [got[i] for *_, i in order] == list(range(1, len(order) + 1))


edges = st.lists(
    st.tuples(st.integers(0, 11), st.integers(0, 11), st.integers(1, 50)), min_size=1, max_size=40
)


@settings(max_examples=6, deadline=None)
@given(edges, st.lists(st.integers(0, 2), min_size=12, max_size=12))
def test_moves_match_recomputation(spark, graph, slots):
    """cut after a move = cut before + delta, for every executor and slot."""
    weight: dict[tuple[int, int], int] = {}
    for a, b, w in graph:
        weight[a, b] = weight.get((a, b), 0) + w
    pairs = spark.createDataFrame(
        [(1, a, a, b, b, w) for (a, b), w in weight.items()],
        "topology_id int, src_begin int, src_end int, dst_begin int, dst_end int, traffic long",
    )
    placement = spark.createDataFrame([(1, e, e, 1, s) for e, s in enumerate(slots)], PLACED)

    def cut(where):
        return sum(w for (a, b), w in weight.items() if where[a] != where[b])

    candidates = spark.createDataFrame(
        [(1, e, e, s) for e in range(12) for s in range(4)],
        "topology_id int, begin_task int, end_task int, to_slot int",
    )
    for r in whatif.score_moves(pairs, placement, candidates).collect():
        moved = list(slots)
        moved[r.begin_task] = r.to_slot
        assert cut(moved) == cut(slots) + r.delta
    sparse = {
        (r.begin_task, r.to_slot): r.delta for r in whatif.score_moves(pairs, placement).collect()
    }
    for e in range(12):
        for s in range(4):
            if s != slots[e]:
                moved = list(slots)
                moved[e] = s
                assert cut(moved) - cut(slots) == sparse.get((e, s), sparse[e, None])


@settings(max_examples=4, deadline=None)
@given(edges, st.lists(st.integers(0, 2), min_size=12, max_size=12), st.integers(3, 13), st.integers(10, 60))
def test_pair_placements_match_recomputation(spark, graph, slots, places, limit):
    weight: dict[tuple[int, int], int] = {}
    for a, b, w in graph:
        weight[a, b] = weight.get((a, b), 0) + w
    loads = [3 + e for e in range(12)]
    pairs = spark.createDataFrame(
        [(1, a, a, b, b, w) for (a, b), w in weight.items()],
        "topology_id int, src_begin int, src_end int, dst_begin int, dst_end int, traffic long",
    )
    placement = spark.createDataFrame([(1, e, e, loads[e], s) for e, s in enumerate(slots)], PLACED)
    held = {s: [e for e in range(12) if slots[e] == s] for s in range(4)}
    state = spark.createDataFrame(
        [(1, s, len(held[s]), sum(loads[e] for e in held[s]), places, limit) for s in range(4)],
        "topology_id int, slot_id int, executors int, load long, max_executors int, max_load long",
    )

    def cut(where):
        return sum(w for (a, b), w in weight.items() if where[a] != where[b])

    scored = pairing.score_pair_placements(pairs, placement, state).collect()
    seen: dict[tuple[int, int], set] = {}
    for r in scored:
        e, g = r.first_begin, r.second_begin
        where = list(slots)
        where[e], where[g] = r.first_slot, r.second_slot
        assert r.cut == cut(where)
        fits = True
        for s in {r.first_slot, r.second_slot}:
            inside = [x for x in range(12) if where[x] == s]
            fits &= len(inside) <= places and sum(loads[x] for x in inside) <= limit
        assert r.feasible == fits
        seen.setdefault((e, g), set()).add(r.first_slot)
    for (e, g), offered in seen.items():
        heavier = max(loads[e], loads[g])
        able = [
            (sum(loads[x] for x in held[s]), s)
            for s in range(4)
            if len(held[s]) < places and sum(loads[x] for x in held[s]) + heavier <= limit
        ]
        assert offered == {slots[e], slots[g]} | ({min(able)[1]} if able else set())


def test_rollup_totals_shrink(rows):
    pairs = rows(
        "topology_id int, src_begin int, src_end int, dst_begin int, dst_end int, traffic long",
        [(1, i % 7, i % 7, i % 5 + 7, i % 5 + 7, i) for i in range(35)],
    )
    swapped = pairs.selectExpr(
        "topology_id", "dst_begin src_begin", "dst_end src_end", "src_begin dst_begin", "src_end dst_end", "traffic"
    )
    placement = rows(PLACED, [(1, e, e, 1, e % 4) for e in range(12)])
    slot_node = rows("topology_id int, slot_id int, node string", [(1, s, "ab"[s % 2]) for s in range(4)])
    slots = rollup.slot_traffic(pairs, placement)
    assert as_set(slots) == as_set(rollup.slot_traffic(swapped, placement))
    total = sum(r.traffic for r in pairs.collect())
    by_slot = sum(r.traffic for r in slots.collect())
    by_node = sum(r.traffic for r in rollup.node_traffic(slots, slot_node).collect())
    assert by_node < by_slot < total


def test_top_k_keeps_ties_in_id_order(rows):
    pairs = rows(
        "topology_id int, src_begin int, src_end int, dst_begin int, dst_end int, traffic long",
        [(1, 3, 3, 1, 1, 5), (1, 1, 1, 3, 3, 5), (1, 2, 2, 1, 1, 9), (2, 1, 1, 2, 2, 1)],
    )
    top = choose.top_executor_pairs(pairs, 2)
    assert as_set(top, "topology_id", "src_begin", "position") == {(1, 2, 1), (1, 1, 2), (2, 1, 1)}
    full = choose.top_executor_pairs(pairs)
    assert as_set(full.filter("position <= 2"), "topology_id", "src_begin", "position") == {
        (1, 2, 1), (1, 1, 2), (2, 1, 1)
    }
