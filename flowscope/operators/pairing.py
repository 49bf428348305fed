"""Placing two units of a pair together or apart: every combination scored, and the best.

A unit is an executor on slots, or a slot on nodes.  It may be unplaced, which is a state of its
own: no place loses anything when it goes, and all its traffic to placed units starts to count
once it has a place.  With one end placed or both, the candidates are the places that hold an
end and the least loaded one that takes the heavier.  With none, the choice is joint: the
least loaded place that takes both; failing that the first unit's own pick, and for the second
a pick of its own among the others.

``A(e, s)`` is the traffic of unit ``e`` with what is placed on ``s``, ``T(e)`` its sum over all
places.  Putting ``e`` on ``b`` changes the cut by ``A(e, a) - A(e, b)`` if it stood on ``a``, and by
``T(e) - A(e, b)`` if it stood nowhere; the traffic of the two with each other is taken out and
counted once by where both end up.  Nothing is tried and undone.

Affinities and units are written to the shared folder, since each is used several times: a
pair then meets its units and their affinities across in four joins, whatever its topology's size.
The first two add the places only; what else is known of a unit comes with its affinity to the
other's place, so that pairs are short while they are dealt out.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.operators.choose import node_steps, step_for
from flowscope.operators.joins import SALTS, spread_join
from flowscope.operators.placement import fits_load
from flowscope.operators.rollup import topology_slots_on_node
from flowscope.operators.whatif import partner_slots, slot_affinity
from flowscope.runtime import written
from flowscope.schema import EXECUTOR, SLOT

# Which combinations of candidates are on offer.
_ALL, _TOGETHER, _APART = 0, 1, 2
# Of a unit that meets pairs: its own place, that of the others, and in how many copies it meets them.
_MET = ["place", "there", "salts"]
# Pairs that may meet one copy of a unit's row.
PAIRS_A_COPY = 50_000


def _zero() -> Column:
    return F.lit(0).cast("long")


def _number(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("long")


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), _zero())


def _undirected(pairs: DataFrame) -> DataFrame:
    """Executor pairs regardless of direction: ``first``, ``second`` structs and ``w``."""
    src = F.struct(F.col("src_begin").alias("begin_task"), F.col("src_end").alias("end_task"))
    dst = F.struct(F.col("dst_begin").alias("begin_task"), F.col("dst_end").alias("end_task"))
    return (
        pairs.filter(src != dst)
        .groupBy("topology_id", F.least(src, dst).alias("first"), F.greatest(src, dst).alias("second"))
        .agg(F.sum("traffic").alias("w"))
    )


def _sides(pairs: DataFrame, units: DataFrame, aff: DataFrame, unit: Sequence[str]) -> DataFrame:
    """``pairs`` with all columns of both units, as ``<column>_1`` and ``<column>_2``, and each one's
    affinity to the other's place, ``across_1`` and ``across_2``.  Pairs keep their rows, whatever is known.

    ``salts`` of a unit, where given, says in how many copies it meets the pairs of one place.
    """
    if "salts" not in units.columns:
        units = units.withColumn("salts", F.lit(SALTS))
    ends = (("first", 1, "second", 2), ("second", 2, "first", 1))
    places = units.select("topology_id", *unit, "place", "salts").distinct()
    both = pairs
    for which, n, other, _ in ends:
        at = [F.col(c).alias(f"{c}_{n}") for c in ("place", "salts")]
        at = places.select("topology_id", F.struct(*unit).alias(which), *at)
        both = _meet(both, at, which, other, F.lit(SALTS), F.lit(SALTS))
    met = written(_met(units, aff, unit), "met")
    for which, n, other, o in ends:
        rest = [F.col(c).alias(f"{c}_{n}") for c in met.columns if c not in ("topology_id", *unit, *_MET)]
        facts = met.select("topology_id", F.struct(*unit).alias(which), *_MET, *rest)
        same = [
            F.col(f"p.place_{n}").eqNullSafe(F.col("f.place")),
            F.col(f"p.place_{o}").eqNullSafe(F.col("f.there")),
        ]
        both = _meet(both, facts, which, other, F.col(f"p.salts_{n}"), F.col("salts"), same).drop(*_MET)
    zero = {c: _or_zero(c) for c in ("load_1", "load_2", "home_1", "home_2", "across_1", "across_2")}
    return both.withColumns(zero)


def _meet(
    pairs: DataFrame, table: DataFrame, which: str, other: str, salts: Column, copies: Column, same: Sequence[Column] = ()
) -> DataFrame:
    """``pairs`` (``p``) with the rows of ``table`` (``f``) on the unit ``which``, spread by the other one.

    Like ``spread_join`` of a table that grows, but the salt is no column: it would be among the
    longest of a short row.
    """
    table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1))).hint("merge")
    keys = [F.col(f"p.{c}") == F.col(f"f.{c}") for c in ("topology_id", which)]
    salt = F.pmod(F.xxhash64(f"p.{other}"), salts).cast("int") == F.col("f.salt")
    joined = pairs.alias("p").join(table.alias("f"), [*keys, *same, salt], "left")
    return joined.select("p.*", *[f"f.{c}" for c in table.columns if c not in ("topology_id", which, "salt")])


def _met(units: DataFrame, aff: DataFrame, unit: Sequence[str]) -> DataFrame:
    """``units`` once for every place ``there`` a partner may have, with their traffic ``across`` to it, and once without."""
    key = F.struct(*unit).alias("unit")
    across = aff.select("topology_id", key, F.col("place").alias("there"), F.col("affinity").alias("across"))
    # Affinities miss pairs with a key that is not whole; these units meet all places, and all units theirs.
    torn = units.filter(functools.reduce(Column.__or__, [F.col(c).isNull() for c in unit]))

    def meet(some: DataFrame, others: DataFrame) -> DataFrame:
        places = others.filter(F.col("place").isNotNull()).select("topology_id", F.col("place").alias("there"))
        some = some.select("topology_id", key)
        return spread_join(some, places.distinct(), ["topology_id"], ["unit"], "inner", grows=True)

    asked = across.drop("across").unionByName(meet(units, torn)).unionByName(meet(torn, units)).distinct()
    asked = asked.join(across.hint("merge"), ["topology_id", "unit", "there"], "left")
    known = asked.join(units.withColumn("unit", key).hint("merge"), ["topology_id", "unit"]).drop("unit")
    return known.unionByName(units, allowMissingColumns=True)


def _affinity_at(aff: DataFrame, unit: Sequence[str], which: str, place: str, name: str) -> DataFrame:
    return aff.select(
        "topology_id", F.struct(*unit).alias(which), F.col("place").alias(place), F.col("affinity").alias(name)
    )


def _homes(units: DataFrame, aff: DataFrame, unit: Sequence[str], picks: Sequence[str] = ()) -> DataFrame:
    """``units`` with ``total`` affinity, ``home`` (that to the own place; all of it without one) and ``at_<pick>``."""
    of = units.select("topology_id", *unit, "place", *picks)

    def to(place: Column) -> Column:
        return F.sum(F.when(F.col("a.place") == place, F.col("a.affinity")))

    sums = (
        aff.alias("a")
        .join(of.hint("merge").alias("u"), ["topology_id", *unit])
        .groupBy("topology_id", *unit)
        .agg(
            F.sum("a.affinity").alias("total"),
            to(F.col("u.place")).alias("__own"),
            *[to(F.col(f"u.{p}.slot_id")).alias(f"at_{p}") for p in picks],
        )
    )
    joined = units.join(sums.hint("merge"), ["topology_id", *unit], "left")
    home = F.when(F.col("place").isNull(), _or_zero("total")).otherwise(_or_zero("__own"))
    return joined.withColumns({"total": _or_zero("total"), "home": home}).drop("__own")


def _spot(place: Column, a1: Column, a2: Column, room: Column, load: Column, limit: Column) -> Column:
    """A candidate as both units see it without the two of them; a place nothing is known of is none."""
    return F.when(
        place.isNotNull() & room.isNotNull(),
        F.struct(
            place.alias("place"),
            a1.cast("long").alias("a1"),
            a2.cast("long").alias("a2"),
            room.cast("long").alias("room"),
            load.cast("long").alias("load"),
            limit.cast("long").alias("limit"),
        ),
    )


def _scored(rows: DataFrame, extra: Sequence[Column], mode: Column) -> DataFrame:
    """Adds ``__choices``: delta, places and feasibility of all combinations on offer.

    ``rows`` come from ``_sides``, with ``own`` (room, load, limit) of each unit's place;
    ``extra`` are two more candidates.  What both units hold is lifted off before room is measured.
    """
    p1, p2 = F.col("place_1"), F.col("place_2")
    w, l1, l2 = F.col("w"), F.col("load_1"), F.col("load_2")
    same, alone = _number(p1 == p2), F.coalesce(p1 != p2, p1.isNull())

    def own(n: int, field: str) -> Column:
        return F.col(f"own_{n}.{field}")

    held = [
        _spot(
            p1, F.col("home_1") - w * same, F.col("across_2") - w,
            own(1, "room") + 1 + same, own(1, "load") - l1 - l2 * same, own(1, "limit"),
        ),
        F.when(
            alone,
            _spot(
                p2, F.col("across_1") - w, F.col("home_2"),
                own(2, "room") + 1, own(2, "load") - l2, own(2, "limit"),
            ),
        ),
    ]
    # A unit's home holds the partner's traffic if both share it, or if it has no home and the
    # partner is placed; it is counted by the last term.
    shared_1 = _number(p2.isNotNull() & (p1.isNull() | (p1 == p2)))
    shared_2 = _number(p1.isNotNull() & (p2.isNull() | (p1 == p2)))
    home = F.col("home_1") - w * shared_1 + F.col("home_2") - w * shared_2
    spots = F.when(mode == _ALL, F.array(*held, extra[0])).otherwise(F.array(*extra))
    rows = rows.withColumns(
        {"__spots": spots, "__mode": mode, "__home": home, "__apart": _number(p1 != p2)}
    )
    numbers = range(3)
    ways = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in numbers for j in numbers])
    offered = F.filter(
        ways,
        lambda c: F.get("__spots", c["i"]).isNotNull()
        & F.get("__spots", c["j"]).isNotNull()
        & (
            (F.col("__mode") == _ALL)
            | ((F.col("__mode") == _TOGETHER) & (c["i"] == 0) & (c["j"] == 0))
            | ((F.col("__mode") == _APART) & (c["i"] == 0) & (c["j"] == 1))
        ),
    )

    def score(c: Column) -> Column:
        a, b, one = F.get("__spots", c["i"]), F.get("__spots", c["j"]), c["i"] == c["j"]
        apart = (~one).cast("long") - F.col("__apart")
        first_ok = (a["room"] >= 1) & fits_load(a["load"], F.col("load_1"), a["limit"])
        with_first = F.col("load_2") + F.when(one, F.col("load_1")).otherwise(_zero())
        second_ok = (b["room"] >= F.when(one, 2).otherwise(1)) & fits_load(b["load"], with_first, b["limit"])
        return F.struct(
            (F.col("__home") - a["a1"] - b["a2"] + F.col("w") * apart).alias("delta"),
            a["place"].alias("first_place"),
            b["place"].alias("second_place"),
            F.coalesce(first_ok & second_ok, F.lit(False)).alias("feasible"),
        )

    return rows.withColumn("__choices", F.transform(offered, score))


def _every(scored: DataFrame, keep: Sequence[str]) -> DataFrame:
    """A row per combination; one without places where none is on offer."""
    out = scored.select("topology_id", "first", "second", *keep, F.inline_outer("__choices"))
    return out.withColumn("feasible", F.coalesce("feasible", F.lit(False)))


def _best(scored: DataFrame, keep: Sequence[str]) -> DataFrame:
    """A row per pair: the feasible combination with the least delta, ties by places; without places if none is."""
    best = F.array_min(F.filter("__choices", lambda c: c["feasible"]))
    return scored.select("topology_id", "first", "second", *keep, F.inline_outer(F.array(best))).drop("feasible")


def slot_picks(state: DataFrame) -> DataFrame:
    """Per topology the least loaded slot with a free place, the next one, and the least loaded with two.

    The load limit is one per topology, so a pick depends on the topology and the places asked
    for: if the least loaded slot breaks the limit, so does every other.
    """
    places = (F.col("max_executors") - F.col("executors")).cast("long")
    rank = F.struct("load", "slot_id", places.alias("room"))
    first = state.groupBy("topology_id").agg(
        F.max("max_load").alias("limit"),
        F.min(F.when(places >= 1, rank)).alias("single"),
        F.min(F.when(places >= 2, rank)).alias("double"),
    )
    rest = spread_join(state, first.select("topology_id", "single"), ["topology_id"], ["slot_id"], "inner")
    after = rest.filter((places >= 1) & (rank > F.col("single"))).groupBy("topology_id").agg(F.min(rank).alias("next"))
    return first.join(after, "topology_id", "left")


def _unknown(aff: DataFrame, units: DataFrame) -> DataFrame:
    """Executors with traffic that are not among ``units``."""
    return aff.select(*EXECUTOR).distinct().join(units.hint("merge"), EXECUTOR, "left_anti")


def executor_units(
    placement: DataFrame, state: DataFrame, aff: DataFrame, picks: DataFrame, executors: DataFrame | None = None
) -> DataFrame:
    """Per executor its place, load, total and home, the state of its slot and its affinities to its topology's picks."""
    own = state.select(
        "topology_id",
        F.col("slot_id").alias("place"),
        F.struct(
            (F.col("max_executors") - F.col("executors")).cast("long").alias("room"),
            F.col("load").cast("long").alias("load"),
            F.col("max_load").cast("long").alias("limit"),
        ).alias("own"),
    )
    if executors is None:
        units = placement.select(*EXECUTOR, "load", F.col("slot_id").alias("place"))
    else:
        where = placement.select(*EXECUTOR, F.col("slot_id").alias("place"))
        units = executors.select(*EXECUTOR, "load").join(where.hint("merge"), EXECUTOR, "left")
    units = units.unionByName(_unknown(aff, units), allowMissingColumns=True)
    units = spread_join(units, own, ["topology_id", "place"], ["begin_task", "end_task"])
    units = spread_join(units, picks, ["topology_id"], ["begin_task", "end_task"])
    units = _homes(units, aff, ["begin_task", "end_task"], ["single", "next", "double"])
    # Only pairs without a place ask for two.
    alone = {c: F.when(F.col("place").isNull(), F.col(c)) for c in ("at_next", "at_double")}
    return units.drop("single", "next", "double", "limit").withColumns(alone)


def topology_facts(units: DataFrame, picks: DataFrame) -> DataFrame:
    """Per topology with units its present cut and its picks."""
    # Every cut pair is in the totals of both its ends.
    outside = F.sum(F.when(F.col("place").isNotNull(), F.col("total") - F.col("home")))
    cut = units.groupBy("topology_id").agg(F.call_function("div", F.coalesce(outside, _zero()), F.lit(2)).alias("cut"))
    return cut.join(picks, "topology_id", "left")


def _executor_choices(
    pairs: DataFrame, placement: DataFrame, state: DataFrame, executors: DataFrame | None
) -> DataFrame:
    unit = ["begin_task", "end_task"]
    placed = placement.filter(F.col("slot_id").isNotNull())
    links = (
        partner_slots(pairs, placed)
        .groupBy(*EXECUTOR, F.col("slot_id").alias("place"))
        .agg(F.sum("traffic").alias("affinity"), F.count(F.lit(1)).alias("n"))
    )
    links = written(links, "affinity")
    aff = links.filter(F.col("place").isNotNull()).drop("n")
    most = F.call_function("div", F.max("n") - 1, F.lit(PAIRS_A_COPY)) + 1
    salts = links.groupBy(*EXECUTOR).agg(most.cast("int").alias("salts"))
    picks = written(slot_picks(state), "picks")
    units = executor_units(placement, state, aff, picks, executors).join(salts.hint("merge"), EXECUTOR, "left")
    units = units.withColumns({"salts": F.coalesce("salts", F.lit(1)), "known": F.lit(True)})
    units = written(units, "units")
    # Written, so that the optimizer sees how few they are and leaves the pairs where they lie.
    facts = written(topology_facts(units, picks), "topologies")
    rows = _sides(_undirected(pairs), units.drop("total"), aff, unit)
    rows = spread_join(rows, facts, ["topology_id"], ["first"])
    known = F.coalesce("known_1", "known_2")

    def of(name: str) -> Column:  # a fact of the topology, where either end is known
        return F.when(known, F.col(name))

    def spot(pick: str) -> Column:
        at = of(pick)
        return _spot(
            at["slot_id"], _or_zero(f"at_{pick}_1"), _or_zero(f"at_{pick}_2"), at["room"], at["load"], of("limit")
        )

    p1, p2, l1, l2 = (F.col(c) for c in ("place_1", "place_2", "load_1", "load_2"))
    none = p1.isNull() & p2.isNull()
    single, both = of("single"), of("double")
    elsewhere = F.coalesce(single["slot_id"] != p1, F.lit(True)) & F.coalesce(single["slot_id"] != p2, F.lit(True))
    heavier_fits = fits_load(single["load"], F.greatest(l1, l2), of("limit"))
    joint = none & both.isNotNull() & fits_load(both["load"], l1 + l2, of("limit"))
    extra = [
        F.when(joint, spot("double")).when(none | (elsewhere & heavier_fits), spot("single")),
        F.when(none & ~joint, spot("next")),
    ]
    mode = F.when(joint, _TOGETHER).when(none, _APART).otherwise(_ALL)
    return _scored(rows.withColumn("cut", of("cut")), extra, mode)


def _named(scored: DataFrame) -> DataFrame:
    return scored.select(
        "topology_id",
        F.col("first.begin_task").alias("first_begin"),
        F.col("first.end_task").alias("first_end"),
        F.col("second.begin_task").alias("second_begin"),
        F.col("second.end_task").alias("second_end"),
        F.col("first_place").alias("first_slot"),
        F.col("second_place").alias("second_slot"),
        (F.col("cut") + F.col("delta")).alias("cut"),
        *[c for c in scored.columns if c == "feasible"],
    )


def score_pair_placements(
    pairs: DataFrame, placement: DataFrame, state: DataFrame, executors: DataFrame | None = None
) -> DataFrame:
    """Cut traffic of the topology for every placement of a pair on its candidate slots.

    At most nine rows per pair with an end placed, one per pair without.  A pair that no slot
    is on offer for has a row with null slots.  Executors are unplaced if their ``slot_id`` is null
    or they are in ``executors`` (with ``load``) only; one that is in neither is unplaced without
    load, and two of these get null slots.
    """
    return _named(_every(_executor_choices(pairs, placement, state, executors), ["cut"]))


def best_pair_placement(
    pairs: DataFrame, placement: DataFrame, state: DataFrame, executors: DataFrame | None = None
) -> DataFrame:
    """The feasible placement of each pair with the least cut traffic, ties by slots.

    One row for every pair; slots and cut are null if no placement is feasible.
    """
    return _named(_best(_executor_choices(pairs, placement, state, executors), ["cut"]))


def slot_units(
    slot_node: DataFrame, slot_loads: DataFrame, nodes: DataFrame, on_node: DataFrame, limits: DataFrame, aff: DataFrame
) -> DataFrame:
    """Per slot its node, load and home, the state of its node, and what its topology may pick."""
    where = slot_node.select(*SLOT, F.col("node").alias("place"))
    units = slot_loads.select(*SLOT, "load").join(where, SLOT, "left")
    state = nodes.select(F.col("name").alias("place"), "free_ports", F.col("load").alias("node_load"), "capacity")
    mine = on_node.select("topology_id", F.col("node").alias("place"), F.col("slots").alias("mine"))
    most = limits.select("topology_id", "max_slots")
    units = (
        spread_join(units, state, ["place"], SLOT)
        .transform(spread_join, mine, ["topology_id", "place"], ["slot_id"])
        .transform(spread_join, most, ["topology_id"], ["slot_id"])
    )
    room = F.least("free_ports", F.col("max_slots") - F.coalesce("mine", F.lit(0))).cast("long")
    own = F.struct(room.alias("room"), F.col("node_load").alias("load"), F.col("capacity").alias("limit"))
    units = units.withColumn("own", own).drop("free_ports", "node_load", "capacity", "mine", "max_slots")
    asks = limits.select("topology_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("__k"))
    steps = node_steps(asks, nodes, on_node, limits).groupBy("topology_id").agg(
        *[F.max(F.when(F.col("__k") == k, F.col("__steps"))).alias(f"__{name}") for k, name in ((1, "single"), (2, "double"))]
    )
    units = spread_join(units, steps, ["topology_id"], ["slot_id"])
    units = units.withColumns(
        {
            "single": step_for("__single", F.col("load")),
            "double": F.when(F.col("place").isNull(), F.col("__double")),  # only pairs without a place ask for two
        }
    ).drop("__single", "__double")
    return _homes(units, aff, ["slot_id"])


def score_slot_pair_placements(
    slots: DataFrame, slot_node: DataFrame, slot_loads: DataFrame, nodes: DataFrame, limits: DataFrame
) -> DataFrame:
    """Change in inter-node traffic for every placement of a slot pair on its candidate nodes.

    At most nine rows per pair with an end placed, one per pair without; a pair that no node is
    on offer for has a row with null nodes.
    """
    slot_node = slot_node.filter(F.col("node").isNotNull())
    on_node = topology_slots_on_node(slot_node)
    aff = written(slot_affinity(slots, slot_node).withColumnRenamed("node", "place"), "affinity")
    units = written(slot_units(slot_node, slot_loads, nodes, on_node, limits, aff), "units")
    pairs = slots.select(
        "topology_id",
        F.struct(F.col("slot_a").alias("slot_id")).alias("first"),
        F.struct(F.col("slot_b").alias("slot_id")).alias("second"),
        F.col("traffic").alias("w"),
    )
    rows = _sides(pairs, units, aff, ["slot_id"])
    none = F.col("place_1").isNull() & F.col("place_2").isNull()
    l1, l2 = F.col("load_1"), F.col("load_2")
    rows = rows.withColumn("__joint", F.when(none, step_for("double_1", l1 + l2)["best"]))
    heavier = F.when(l1 >= l2, F.col("single_1")).otherwise(F.col("single_2"))["best"]
    first, second = F.col("single_1"), F.col("single_2")
    taken = F.coalesce(second["best"]["node"] == first["best"]["node"], F.lit(False))
    rows = rows.withColumns(
        {
            "__e1": F.when(~none, heavier).otherwise(F.coalesce("__joint", first["best"])),
            "__e2": F.when(none & F.col("__joint").isNull(), F.when(taken, second["next"]).otherwise(second["best"])),
        }
    ).withColumns({"__n1": F.col("__e1.node"), "__n2": F.col("__e2.node")})
    for which, place, name in (("first", "__n1", "__a11"), ("second", "__n1", "__a21"), ("second", "__n2", "__a22")):
        other = "second" if which == "first" else "first"
        rows = spread_join(
            rows, _affinity_at(aff, ["slot_id"], which, place, name), ["topology_id", which, place], [other]
        )

    def spot(n: int, a1: Column, a2: Column) -> Column:
        e = F.col(f"__e{n}")
        return _spot(F.col(f"__n{n}"), a1, a2, e["room"], e["load"], e["capacity"])

    held = F.coalesce(F.col("__n1") == F.col("place_1"), F.lit(False))
    held = held | F.coalesce(F.col("__n1") == F.col("place_2"), F.lit(False))
    extra = [
        F.when(none | ~held, spot(1, _or_zero("__a11"), _or_zero("__a21"))),
        spot(2, _zero(), _or_zero("__a22")),
    ]
    mode = F.when(F.col("__joint").isNotNull(), _TOGETHER).when(none, _APART).otherwise(_ALL)
    return _every(_scored(rows, extra, mode), []).select(
        "topology_id",
        F.col("first.slot_id").alias("slot_a"),
        F.col("second.slot_id").alias("slot_b"),
        F.col("first_place").alias("node_a"),
        F.col("second_place").alias("node_b"),
        "delta",
        "feasible",
    )
