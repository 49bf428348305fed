"""Placement parameters: parsing, defaults, validation and the derived limits.

Products with ``alfa``, ``beta`` and ``gamma`` are taken in 32-bit floats, the
one with ``delta`` in doubles; both operands are cast because Spark widens
``float * int`` to double, which moves the ``ceil`` by one for values like 0.1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Configuration keys and defaults.
CONF_KEYS = {
    "alfa": ("alfa", "float"),
    "beta": ("beta", "float"),
    "gamma": ("gamma", "float"),
    "delta": ("delta", "float"),
    "epsilon": ("epsilon", "float"),
    "traffic.improvement": ("improvement", "int"),
    "reschedule.timeout": ("timeout_s", "int"),
}
DEFAULTS = {"alfa": 0.0, "beta": 1.0, "delta": 0.0, "epsilon": 0.5}
DEFAULT_TIMEOUT_S = 180


def parse_params(df: DataFrame, conf: str = "conf") -> DataFrame:
    """Typed nullable columns from a ``map<string,string>`` configuration column."""
    typed = {
        name: F.element_at(F.col(conf), F.lit(key)).cast(kind)
        for key, (name, kind) in CONF_KEYS.items()
    }
    return df.withColumns(typed).drop(conf)


def default_params(df: DataFrame) -> DataFrame:
    """Fill absent parameters.  ``gamma`` stays null: no load limit."""
    filled = {
        name: F.coalesce(F.col(name).cast("float"), F.lit(value).cast("float"))
        for name, value in DEFAULTS.items()
        if name in df.columns
    }
    if "gamma" in df.columns:
        filled["gamma"] = F.col("gamma").cast("float")
    if "timeout_s" in df.columns:
        filled["timeout_s"] = F.coalesce("timeout_s", F.lit(DEFAULT_TIMEOUT_S))
    return df.withColumns(filled)


def validate_params(df: DataFrame) -> DataFrame:
    """Rows with out-of-range values, with the names of the offending columns.

    ``improvement`` has no default, so a missing one is reported too.
    """
    in_unit = {name: F.col(name).between(0, 1) for name in ("alfa", "beta", "delta")}
    ok = {
        **in_unit,
        "gamma": F.col("gamma") >= 1,
        "capacity_pct": F.col("capacity_pct").between(1, 100),
        "improvement": F.coalesce(F.col("improvement").between(1, 100), F.lit(False)),
    }
    broken = F.array_compact(
        F.array(*[F.when(~test, F.lit(name)) for name, test in ok.items() if name in df.columns])
    )
    return df.withColumn("broken", broken).filter(F.size("broken") > 0)


def _float(value) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("float")


def _col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def _ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a.cast("double") / b).cast("int")


def slot_count(workers, executors) -> Column:
    """A job never has more slots than executors."""
    return F.least(_col(workers), _col(executors)).cast("int")


def max_executors_per_slot(executors, slots, alfa) -> Column:
    """Between an even spread (alfa 0) and everything in one slot (alfa 1)."""
    executors, slots = _col(executors), _col(slots)
    lo = _ceil_div(executors, slots)
    hi = executors - slots + 1
    return (lo + F.ceil(_float(alfa) * _float(hi - lo))).cast("int")


def nodes_to_use(nodes, slots, beta) -> Column:
    slots = _col(slots)
    n = F.least(_col(nodes), slots)
    lo = _ceil_div(slots, n)
    return (lo + F.ceil(_float(beta) * _float(n - lo))).cast("int")


def max_slots_per_node(nodes, slots, beta, delta) -> Column:
    slots = _col(slots)
    used = nodes_to_use(nodes, slots, beta)
    lo = _ceil_div(slots, used)
    hi = slots - used + 1
    return (lo + F.ceil(_float(delta).cast("double") * (hi - lo).cast("double"))).cast("int")


def max_load_per_slot(total_load, slots, gamma) -> Column:
    """Null when ``gamma`` is null."""
    return (_float(gamma) * int_div(total_load, slots).cast("float")).cast("long")


def int_div(a, b) -> Column:
    """Exact integer quotient, truncated (all inputs here are non-negative)."""
    return F.call_function("div", _col(a).cast("long"), _col(b).cast("long"))


def absolute_capacity(total_speed, percent) -> Column:
    return int_div(total_speed, F.lit(100)) * _col(percent)


def mhz_to_hz(mhz) -> Column:
    """Whole megahertz only, binary mega."""
    return _col(mhz).cast("float").cast("long") * F.lit(1024 * 1024)


def traffic_threshold(current, improvement) -> Column:
    """Largest proposed traffic still worth a change.

    A float quotient equals the double quotient rounded to float, so the
    division is done in double (the only division Spark has) and cast back.
    """
    share = (_col(improvement).cast("double") / F.lit(100.0)).cast("float")
    kept = F.lit(1.0).cast("float") - share
    return (_float(_col(current)) * kept).cast("long")
