"""Joins of many rows with a lookup table when a few keys may own most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

SALTS = 8


def spread_join(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    salts: int = SALTS,
    grows: bool = False,
) -> DataFrame:
    """Joins ``rows`` with ``table`` on ``keys``, each key spread over ``salts`` partitions.

    ``spread_by`` are columns of ``rows`` that differ within a key.  The table
    is repeated once per salt; it is the short side.  Because the repeated
    table always gets an exchange of its own, the adaptive skew join can also
    split what is still too large after salting - it cannot where the table is
    already partitioned by an aggregation on the same keys.  A table that turns
    out small enough is broadcast by the optimizer as usual.

    ``grows`` says that the table has a row per task, executor or pair.  The
    optimizer sees neither the copies nor what was unrolled before, so it would
    hand such a table to the driver at any size; it is merged instead.
    """
    by = [c for c in spread_by if not isinstance(rows.schema[c].dataType, MapType)]
    if not by:  # nothing tells the rows of a key apart
        return rows.join(table.hint("merge") if grows else table, list(keys), how)
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if grows:
        copies = copies.hint("merge")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")
