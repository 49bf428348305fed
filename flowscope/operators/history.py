"""Assignment snapshots: text form, maps, and changes from one to the next.

A snapshot is rows ``snapshot, host, port, executor``.  Executors in a slot are
a set.  One slot, and one host, is a bounded group; only one short row per
snapshot reaches the ordered comparison.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.functions.text import list_to_csv
from flowscope.operators.series import previous_value

_EMPTY = "empty"


def slot_contents(snapshots: DataFrame, keys: Sequence[str] = ("snapshot",)) -> DataFrame:
    """The sorted distinct executors of each slot as ``executors``."""
    return (
        snapshots.select(*keys, "host", "port", "executor")
        .distinct()
        .groupBy(*keys, "host", "port")
        .agg(F.array_sort(F.collect_list("executor")).alias("executors"))
    )


def assignment_map(snapshots: DataFrame, keys: Sequence[str] = ("snapshot",)) -> DataFrame:
    """One row per host: ``slots`` maps a port to its executors."""
    return (
        slot_contents(snapshots, keys)
        .groupBy(*keys, "host")
        .agg(F.map_from_entries(F.collect_list(F.struct("port", "executors"))).alias("slots"))
    )


def serialize_hosts(snapshots: DataFrame, keys: Sequence[str] = ("snapshot",)) -> DataFrame:
    """``(host:port e1, e2)`` of the slots of each host in port order, as ``assignment``."""
    text = F.format_string("(%s:%d %s)", F.col("host"), F.col("port"), list_to_csv("executors"))
    slots = F.array_sort(F.collect_list(F.struct("port", text.alias("text"))))
    return (
        slot_contents(snapshots, keys)
        .groupBy(*keys, "host")
        .agg(F.array_join(F.transform(slots, lambda s: s["text"]), "").alias("assignment"))
    )


def serialize_assignment(snapshots: DataFrame, keys: Sequence[str] = ("snapshot",)) -> DataFrame:
    """The text of a whole snapshot, hosts in order: one row, as long as the cluster is big."""
    hosts = F.array_sort(F.collect_list(F.struct("host", "assignment")))
    return (
        serialize_hosts(snapshots, keys)
        .groupBy(*keys)
        .agg(F.array_join(F.transform(hosts, lambda h: h["assignment"]), "").alias("assignment"))
    )


CONTENT = ("host", "port", "executor")
_WORDS = 8


def digested(rows: DataFrame, keys: Sequence[str | Column], content: Sequence[str] = CONTENT) -> DataFrame:
    """A 256-bit digest of the set of rows of each key, as ``fingerprint``, and their number, ``rows``.

    The sum, word by word, of the rows' own hashes, with their count: it does not depend on the
    order, partial sums can be added, and no row ever holds a set.  The rows of a key are distinct.
    A row whose content is null as a whole is not counted.
    """
    present = F.greatest(*[F.col(c).isNotNull() for c in content])
    mark = F.sha2(F.to_json(F.struct(*content)), 256)
    words = [F.conv(F.substring(mark, 8 * i + 1, 8), 16, 10).cast("long") for i in range(_WORDS)]
    sums = rows.groupBy(*keys).agg(
        F.count(F.when(present, 1)).alias("rows"),
        *[F.sum(F.when(present, w)).alias(f"__word{i}") for i, w in enumerate(words)],
    )
    texts = [F.lpad(F.hex(F.pmod(F.col(f"__word{i}"), F.lit(1 << 32))), 8, "0") for i in range(_WORDS)]
    fingerprint = F.concat_ws("", *texts, F.lit("-"), F.col("rows").cast("string"))
    return sums.withColumn("fingerprint", fingerprint).drop(*[f"__word{i}" for i in range(_WORDS)])


def fingerprints(snapshots: DataFrame, keys: Sequence[str] = ("snapshot",)) -> DataFrame:
    """A digest of each snapshot's content; order and duplicates do not matter."""
    return digested(snapshots.select(*keys, *CONTENT).distinct(), keys).select(*keys, "fingerprint")


def assignment_changes(
    snapshots: DataFrame,
    taken: DataFrame | None = None,
    cluster: Sequence[str] = (),
    piece: Column | None = None,
) -> DataFrame:
    """Snapshots that differ from the one before; the first one always does.

    ``taken`` lists all snapshots including those with nothing assigned: an
    empty one is remembered as a difference but not reported.
    """
    keys = [*cluster, "snapshot"]
    marks = fingerprints(snapshots, keys)
    if taken is not None:
        marks = taken.select(*keys).distinct().join(marks, keys, "left")
    marks = marks.withColumn("fingerprint", F.coalesce("fingerprint", F.lit(_EMPTY)))
    piece = F.date_trunc("month", F.col("snapshot")) if piece is None else piece
    lagged = previous_value(marks, list(cluster), ["snapshot"], "fingerprint", piece, "__before")
    changed = F.col("__before").isNull() | (F.col("fingerprint") != F.col("__before"))
    return lagged.filter(changed & (F.col("fingerprint") != _EMPTY)).select(*keys)


def assignment_rows(
    changes: DataFrame, snapshots: DataFrame, topologies: DataFrame, keys: Sequence[str] = ("snapshot",)
) -> DataFrame:
    """Rows to append for changed snapshots: ``topologies`` as csv and ``assignment`` text.

    ``topologies`` has one row per (snapshot, topology_key).
    """
    names = (
        topologies.select(*keys, "topology_key")
        .distinct()
        .groupBy(*keys)
        .agg(list_to_csv(F.array_sort(F.collect_list("topology_key"))).alias("topologies"))
    )
    kept = snapshots.join(changes, list(keys), "left_semi")
    return (
        changes.join(serialize_assignment(kept, keys), list(keys))
        .join(names, list(keys), "left")
        .select(*keys, "topologies", "assignment")
    )
