"""Quality rules with host-level verdicts.

Every document is measured once, rule failures are counted by host, each host's failure
rates are shrunk by a beta prior fitted to all hosts, and hosts whose shrunk rate of a rule
passes its limit take all their documents with them.

Defined results: a null or empty text has no words, so it fails ``too_short``.  Documents of
a null or empty host share one unnamed host, which is counted in the prior but never
rejected.  Repeated rows and ties count as often as they occur.  An empty table gives an
empty result.  Further columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from flowscope.llm.hashing import BLANK, documents_words, in_blocks, windows
from flowscope.llm.tables import column, cut, fresh, lean, only
from flowscope.operators.joins import spread_join

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5
BLOCK = 2 << 20
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
UNNAMED = ""


@dataclass(frozen=True)
class Limits:
    """Limits of the rules on documents, and of the shrunk rates of hosts."""

    min_words: int = 10
    max_repeat_pct: int = 20
    max_symbol_pct: int = 50
    max_dup_lines_pct: int = 50
    # A host goes when one of its shrunk failure rates is above that rule's limit.
    host_rates: dict[str, float] = field(
        default_factory=lambda: {"too_short": 0.8, "repetitive": 0.8, "symbols": 0.8, "dup_lines": 0.8}
    )
    # Strengths of the prior, in documents: the least and the most.
    min_strength: float = 1.0
    max_strength: float = 1e6


def _repeat_words(grams: np.ndarray) -> int:
    """Words within windows that occur at least twice; ``grams`` are a text's window hashes."""
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(grams) + WINDOW, np.int64)
    edge[: len(grams)] += twice
    edge[WINDOW:] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _dup_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += bool(line.strip(BLANKS))
        else:
            seen.add(line)
    return n


def measures(texts: pa.Array) -> pa.Array:
    """The measures of each text; null counts as empty."""
    values = [t or "" for t in texts.to_pylist()]
    out = []
    for part in in_blocks([len(t) for t in values], BLOCK):
        block = values[part]
        hashes, begin = documents_words([t.encode() for t in block], BLANK)
        for i, t in enumerate(block):
            own = hashes[begin[i] : begin[i + 1]]
            chars = len(t) - sum(map(t.count, BLANKS))
            repeat = _repeat_words(windows(own, WINDOW))
            out.append((len(own), chars, sum(map(t.count, SYMBOLS)), _dup_lines(t), repeat, t.count("\n") + 1))
    names = [*MEASURES, "n_lines"]
    columns = list(zip(*out, strict=True)) or [[]] * len(names)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _every(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return map(measures, batches)


def _lean_measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from lean(_every)(batches)


def failures(m: Column, limits: Limits) -> dict[str, Column]:
    """Each rule's failure, from the struct of ``measures``."""
    return {
        "too_short": m["n_words"] < limits.min_words,
        "repetitive": 100 * m["n_repeat_words"] > limits.max_repeat_pct * m["n_words"],
        "symbols": 100 * m["n_symbols"] > limits.max_symbol_pct * m["n_words"],
        "dup_lines": 100 * m["n_dup_lines"] > limits.max_dup_lines_pct * m["n_lines"],
    }


def _prior(hosts: int, rates: float, squares: float, noise: float, limits: Limits) -> tuple[float, float]:
    """Mean and strength of the beta prior of one rule, by moments over hosts, each counted once.

    ``rates`` and ``squares`` are sums of the hosts' failure rates and of their squares.
    ``noise`` sums r (1 - r) / (n - 1), what the hosts' sizes alone explain of the scatter.
    """
    if not hosts:
        return 0.0, limits.max_strength
    p = rates / hosts
    spread = squares / hosts - p * p - noise / hosts
    if not 0 < p < 1 or spread <= 0:
        return p, limits.max_strength
    return p, min(max(p * (1 - p) / spread - 1, limits.min_strength), limits.max_strength)


def host_verdicts(measured: DataFrame, host: str, m: str, limits: Limits) -> DataFrame:
    """host, n, each rule's shrunk rate, rejected; one row per host.

    The prior of a rule is Beta(p M, (1 - p) M): p is the mean of the failure rates of hosts
    and M follows, by moments, from how far these scatter beyond what the hosts' sizes
    explain.  Hosts count alike, so ten times the documents of each host leave the prior as it
    is but for that noise.  Hosts of one document tell nothing of the scatter and are left
    out of the prior (they are judged by it like others).
    """
    fails = failures(column(m), limits)
    hosts = measured.groupBy(F.coalesce(column(host), F.lit(UNNAMED)).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f.cast("long")).alias(f"k_{r}") for r, f in fails.items()]
    )
    rate = {r: F.col(f"k_{r}") / F.col("n") for r in fails}
    totals = hosts.filter("n > 1").agg(
        F.count(F.lit(1)).alias("hosts"),
        *[F.sum(rate[r]).alias(f"rates_{r}") for r in fails],
        *[F.sum(rate[r] * rate[r]).alias(f"squares_{r}") for r in fails],
        *[F.sum(rate[r] * (1 - rate[r]) / (F.col("n") - 1)).alias(f"noise_{r}") for r in fails],
    ).first()  # one row of sums, whatever the number of hosts
    rates = []
    for r in fails:
        sums = [totals[f"{what}_{r}"] or 0.0 for what in ("rates", "squares", "noise")]
        p, strength = _prior(totals["hosts"], *sums, limits)
        rates.append(((F.col(f"k_{r}") + p * strength) / (F.col("n") + strength)).alias(f"rate_{r}"))
    shrunk = hosts.select("host", "n", *rates)
    bad = [F.col(f"rate_{r}") > limits.host_rates[r] for r in fails]
    return shrunk.withColumn("rejected", (F.col("host") != UNNAMED) & F.greatest(*bad))


def measured_documents(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with the struct of measures in a column ``name``."""
    # Called once a row: a deterministic function would be evaluated again for each later filter.
    measure = arrow_udf(_lean_measures, ", ".join(f"{m} long" for m in (*MEASURES, "n_lines"))).asNondeterministic()
    return docs.withColumn(name, measure(column(text)))


def quality_verdicts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limits: Limits | None = None
) -> DataFrame:
    """doc_id, the measures, base_failed, host_rejected, kept; one row per document."""
    limits = limits or Limits()
    measured = measured_documents(only(docs, doc_id=doc_id, text=text, host=host), "text", "m").drop("text")
    measured = cut(measured, "measures")  # a few numbers a document, so that texts are read once
    hosts = host_verdicts(measured, "host", "m", limits).select("host", F.col("rejected").alias("host_rejected"))
    fails = failures(F.col("m"), limits)
    base = fails["too_short"] | fails["repetitive"]
    judged = spread_join(
        measured.withColumn("host", F.coalesce("host", F.lit(UNNAMED))), hosts, ["host"], ["doc_id", "m"]
    )
    return judged.select(
        "doc_id", *[F.col("m")[c].alias(c) for c in MEASURES], base.alias("base_failed"), "host_rejected",
        (~base & ~F.col("host_rejected")).alias("kept"),
    )


def keep_quality(
    docs: DataFrame, text: str = "text", host: str = "source", limits: Limits | None = None
) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and whose host passes too, all columns unchanged."""
    limits = limits or Limits()
    m = fresh(docs, "measures")
    hosts = host_verdicts(measured_documents(only(docs, text=text, host=host), "text", m), "host", m, limits)
    # Stored, so that the optimizer knows how few there are before it chooses the join.
    rejected = hosts.filter("rejected").select(F.col("host").alias(h := fresh(docs, "rejected_host")))
    rejected = cut(rejected, "rejected")
    fails = failures(column(m), limits)
    kept = measured_documents(docs, text, m).filter(~fails["too_short"] & ~fails["repetitive"])
    return kept.join(rejected, column(host) == column(h), "left_anti").select(*[column(c) for c in docs.columns])
