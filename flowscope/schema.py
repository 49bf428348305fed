"""Table shapes.  All columns are required; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, False) for name, kind in fields])


_INT, _LONG, _STR = T.IntegerType(), T.LongType(), T.StringType()

TOPOLOGY = _struct(("topology_id", _INT), ("topology_key", _STR))
LOAD = _struct(
    ("topology_id", _INT), ("begin_task", _INT), ("end_task", _INT), ("load", _LONG), ("node", _STR)
)
TRAFFIC = _struct(
    ("topology_id", _INT), ("source_task", _INT), ("destination_task", _INT), ("traffic", _INT)
)
NODE = _struct(("name", _STR), ("capacity", _LONG), ("cores", _INT))
ASSIGNMENT = _struct(("time", T.TimestampType()), ("topologies", _STR), ("assignment", _STR))

TABLES = {
    "topology": TOPOLOGY,
    "load": LOAD,
    "traffic": TRAFFIC,
    "node": NODE,
    "assignment": ASSIGNMENT,
}

RECEIPT = _struct(
    ("ts", T.TimestampType()),
    ("topology_key", _STR),
    ("source_task", _INT),
    ("destination_task", _INT),
)
COUNTER_SAMPLE = _struct(("thread_id", _LONG), ("ts", T.TimestampType()), ("cpu_total", _LONG))

# Column groups used as join and grouping keys throughout.
EXECUTOR = ["topology_id", "begin_task", "end_task"]
SLOT = ["topology_id", "slot_id"]
EXECUTOR_PAIR = ["topology_id", "src_begin", "src_end", "dst_begin", "dst_end"]
