"""Text rendering of lists, pairs, timestamps and ``key : value`` lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders and formats of the rendered text.
NULL_TEXT = "null"
EMPTY_LIST = "<empty list>"
EMPTY_MAP = "<empty map>"
LIST_SEPARATOR = ", "
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def list_to_csv(items) -> Column:
    items = _col(items)
    return (
        F.when(items.isNull(), F.lit(NULL_TEXT))
        .when(F.size(items) == 0, F.lit(EMPTY_LIST))
        .otherwise(
            F.array_join(F.transform(items, lambda x: x.cast("string")), LIST_SEPARATOR, NULL_TEXT)
        )
    )


def map_to_text(mapping) -> Column:
    """``k -> (a, b)`` entries in key order."""
    mapping = _col(mapping)
    entries = F.array_sort(F.map_keys(mapping))
    text = F.transform(
        entries,
        lambda k: F.concat(
            k.cast("string"),
            F.lit(" -> ("),
            list_to_csv(F.element_at(mapping, k)),
            F.lit(")"),
        ),
    )
    return (
        F.when(mapping.isNull(), F.lit(NULL_TEXT))
        .when(F.size(mapping) == 0, F.lit(EMPTY_MAP))
        .otherwise(F.array_join(text, LIST_SEPARATOR))
    )


def format_ts(ts) -> Column:
    return F.date_format(_col(ts), TIMESTAMP_FORMAT)


def key_of(line) -> Column:
    """Trimmed text before the first colon; null without a colon."""
    line = _col(line)
    return F.when(F.contains(line, F.lit(":")), F.trim(_untab(F.substring_index(line, ":", 1))))


def value_of(line) -> Column:
    """Trimmed text after the first colon; null without a colon."""
    line = _col(line)
    rest = F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1)
    return F.when(F.contains(line, F.lit(":")), F.trim(_untab(rest)))


def _untab(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\t\r\n ]+|[\t\r\n ]+$", "")


def task_pair_label(source, destination) -> Column:
    return F.format_string("[%d->%d]", _col(source), _col(destination))


def executor_label(begin, end) -> Column:
    """Null for a missing executor."""
    label = F.format_string("[%d, %d]", _col(begin), _col(end))
    return F.when(_col(begin).isNotNull(), label)


def executor_text(component, begin, end) -> Column:
    """How an assignment names an executor: ``component[begin,end]``."""
    return F.format_string("%s[%d,%d]", _col(component), _col(begin), _col(end))


def executor_pair_label(src_begin, src_end, dst_begin, dst_end, traffic) -> Column:
    return F.format_string(
        "{%s -> %s: %d tuple/s}",
        executor_label(src_begin, src_end),
        executor_label(dst_begin, dst_end),
        _col(traffic),
    )


def slot_pair_label(slot_a, slot_b, traffic) -> Column:
    return F.format_string(
        "{%d; %d; traffic: %d tuple/s}", _col(slot_a), _col(slot_b), _col(traffic)
    )
