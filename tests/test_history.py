from __future__ import annotations

import datetime as dt

from conftest import as_set

from flowscope.operators import history, sets, whatif
from flowscope.sources import latest, tables

D = [dt.date(2024, 1, 30) + dt.timedelta(days=i) for i in range(6)]
SNAP = "snapshot date, host string, port int, executor string"


def snapshots(rows):
    return rows(
        SNAP,
        [
            (D[0], "a", 1, "x"), (D[0], "a", 1, "y"), (D[0], "b", 2, "z"),
            (D[1], "b", 2, "z"), (D[1], "a", 1, "y"), (D[1], "a", 1, "x"), (D[1], "a", 1, "x"),
            (D[2], "a", 1, "x"), (D[2], "b", 2, "z"),
            (D[4], "a", 1, "x"), (D[4], "b", 2, "z"),
            (D[5], "a", 1, "x"), (D[5], "b", 2, "z"),
        ],
    )


def test_changes_ignore_order_and_cross_month_pieces(rows):
    assert as_set(history.assignment_changes(snapshots(rows))) == {(D[0],), (D[2],)}


def test_an_empty_snapshot_is_remembered_but_not_reported(rows):
    taken = rows("snapshot date", [(d,) for d in D])
    assert as_set(history.assignment_changes(snapshots(rows), taken)) == {(D[0],), (D[2],), (D[4],)}


def test_text_and_map(rows, spark):
    text = history.serialize_assignment(snapshots(rows)).filter(f"snapshot = '{D[1]}'")
    assert as_set(text, "assignment") == {("(a:1 x, y)(b:2 z)",)}
    folded = history.assignment_map(snapshots(rows)).filter(f"snapshot = '{D[1]}'")
    assert {r.host: r.slots for r in folded.collect()} == {"a": {1: ["x", "y"]}, "b": {2: ["z"]}}


def test_appended_assignments_accumulate(rows, spark, tmp_path):
    topologies = rows("snapshot date, topology_key string", [(d, k) for d in D for k in ("t2", "t1")])
    changes = history.assignment_changes(snapshots(rows))
    done = history.assignment_rows(changes, snapshots(rows), topologies)
    path = str(tmp_path / "log")
    for _ in range(2):
        tables.append_assignments(done.withColumnRenamed("snapshot", "time"), path)
    stored = tables.read_assignments(spark, path)
    assert stored.count() == 4
    for _ in range(2):
        tables.append_assignments(done.withColumnRenamed("snapshot", "time"), path, batch="b1")
    assert tables.read_assignments(spark, path).count() == 6
    assert as_set(stored.filter(f"day = '{D[2]}'"), "topologies", "assignment") == {
        ("t1, t2", "(a:1 x)(b:2 z)")
    }


def test_latest_wins_and_repeats_change_nothing(rows):
    log = rows(
        "topology_id int, begin_task int, end_task int, load long, node string, version int",
        [(1, 1, 2, 5, "a", 1), (1, 1, 2, 7, "b", 2), (1, 3, 4, 9, "a", 1)],
    )
    expected = {(1, 1, 2, 7, "b"), (1, 3, 4, 9, "a")}
    assert as_set(latest.latest_load(log)) == expected
    assert as_set(latest.latest_load(log.union(log))) == expected


def test_node_registration(rows):
    schema = "name string, capacity long, cores int"
    known = rows(schema, [("a", 10, 2), ("b", 20, 4)])
    incoming = rows(schema, [("a", 11, 9), ("c", 30, 6)])
    assert as_set(latest.upsert_node(known, incoming)) == {("a", 11, 2), ("b", 20, 4), ("c", 30, 6)}
    again = incoming.selectExpr("name", "capacity", "cores", "1 as v").unionByName(
        incoming.selectExpr("name", "capacity + 5 as capacity", "cores + 1 as cores", "2 as v")
    )
    assert as_set(latest.upsert_node(known, again, ["v"])) == {("a", 16, 2), ("b", 20, 4), ("c", 35, 6)}


def test_registered_ids_are_stable(rows):
    known = rows("topology_id int, topology_key string", [(4, "x"), (9, "y")])
    incoming = rows("topology_key string", [("y",), ("p",), ("q",), ("p",)])
    first = latest.register_topologies(known, incoming)
    got = {k: i for i, k in as_set(first)}
    assert got["x"] == 4 and got["y"] == 9 and {got["p"], got["q"]} == {10, 11}
    assert as_set(latest.register_topologies(first, incoming)) == as_set(first)
    empty = known.limit(0)
    assert {i for i, _ in as_set(latest.register_topologies(empty, incoming))} == {1, 2, 3}


def test_purge_and_sets(rows):
    known = rows("topology_id int, topology_key string", [(1, "x"), (2, "y")])
    live = rows("topology_key string", [("y",), ("new",)])
    stale = sets.stale_topologies(known, live)
    assert as_set(stale, "topology_id") == {(1,)}
    assert as_set(sets.active_topologies(known, live), "topology_id") == {(2,)}
    assert as_set(latest.purge(known, stale), "topology_id") == {(2,)}


LOAD = "topology_id int, begin_task int, end_task int, load long, node string"


def decision(rows, proposed, improvement=20):
    current = rows(LOAD, [(1, 1, 1, 5, "a"), (1, 2, 2, 5, "b"), (1, 3, 3, 5, "a")])
    traffic = rows(
        "topology_id int, source_task int, destination_task int, traffic int", [(1, 1, 2, 10), (1, 2, 3, 2)]
    )
    node = rows("name string, capacity long, cores int", [("a", 8, 1), ("b", 99, 1), ("c", 99, 1)])
    return whatif.reschedule_decision(traffic, current, rows(LOAD, proposed), node, improvement).collect()[0]


def test_decision_reasons(rows):
    better = decision(rows, [(1, 1, 1, 5, "a"), (1, 2, 2, 5, "a"), (1, 3, 3, 5, "b")])
    assert (better.current_traffic, better.best_traffic, better.threshold) == (12, 2, 9)
    assert better.due_to_traffic and not better.due_to_overload and better.wanted
    relieved = decision(rows, [(1, 1, 1, 5, "a"), (1, 2, 2, 5, "b"), (1, 3, 3, 5, "c")])
    assert not relieved.due_to_traffic and relieved.due_to_overload and relieved.wanted
    same = decision(rows, [(1, 1, 1, 5, "a"), (1, 2, 2, 5, "b"), (1, 3, 3, 5, "a")])
    assert not same.wanted
    absent = decision(rows, [(1, 1, 1, 5, "c"), (1, 2, 2, 5, "b"), (1, 3, 3, 5, "c")])
    assert not absent.due_to_overload


def test_nothing_placed_never_wants_a_change(rows):
    nothing = decision(rows, [(1, i, i, 5, None) for i in (1, 2, 3)])
    assert nothing.best_traffic is None and not nothing.wanted


def test_jdbc_options_split_on_topology():
    options = tables.jdbc_options("traffic", "jdbc:any:db", partitions=8, bounds=(0, 800))
    assert options["partitionColumn"] == "topology_id" and options["numPartitions"] == "8"
    assert "partitionColumn" not in tables.jdbc_options("node", "jdbc:any:db", partitions=8)


def test_fixed_schema_and_pruned_scan(rows, spark, tmp_path):
    path = str(tmp_path / "load")
    tables.write_table(rows(LOAD, [(1, 1, 2, 5, "a")]), "load", path)
    read = tables.read_table(spark, "load", path, ["load"])
    assert read.dtypes == [("load", "bigint")]
    assert "ReadSchema: struct<load:bigint>" in read._jdf.queryExecution().toString()
