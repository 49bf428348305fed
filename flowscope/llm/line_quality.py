"""Document quality from a linear-chain conditional random field over lines.

Every line is described by what stands in it (length, letters, symbols, repetition, whether it
stood before), in bins, together with the bins of the lines before and after it.  A chain of
two states, good and bad, is fitted to labelled documents, whose label all their lines carry;
the forward-backward algorithm gives every line's chance of being good, and the mean of these,
weighted by the lines' lengths, is the document's quality.

The model is fitted on the driver to a bounded sample: so many documents of each label, of at
most so many lines each.  Every document is scored whole, in the tasks that read it.

Defined results: a null or empty text is one empty line and scores as such.  Labels other than 0
and 1 and labels without a document are ignored; a document labelled both ways counts as bad;
of several texts under one id the first in order is learned from, and a sample's ties go to the
smaller id.  Without any good or any bad document every score is 0.5.  Repeated rows are scored
row by row, an empty table gives an empty result.  Long lines and texts of many lines are
scored whole; memory is bounded by the longest text.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from flowscope.llm.hashing import BLANK, hash_words, in_blocks, mix
from flowscope.llm.tables import cut, lean, only, sampled

# The sample a model is fitted on: documents of each label, and lines of each.
SAMPLE_PER_LABEL = 4000
SAMPLE_LINES = 400
BINS = 10
BLOCK = 4 << 20
RIDGE = 1.0
STEPS = 120

UPPER, DIGIT, MARK, SYMBOL, GAP = range(1, 6)  # all other bytes belong to small or other letters
MEASURES = (
    "bytes", "words", "upper", "digits", "marks", "symbols", "symbol_ends",
    "word_bytes", "gaps", "echoes", "variety", "seen", "lines",
)
_U = np.uint64


def _classes() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    for c in range(128):
        ch = chr(c)
        if ch.isupper():
            kinds[c] = UPPER
        elif ch.isdigit():
            kinds[c] = DIGIT
        elif ch in ".,;:?'\"-()":
            kinds[c] = MARK
        elif ch in " \t\n\x0b\x0c\r":
            kinds[c] = GAP
        elif not ch.islower():
            kinds[c] = SYMBOL
    return kinds


CLASSES = _classes()


def measured_lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The measures of every line of all texts in a row, and where each text's lines begin (one more at the end)."""
    data = "\n".join(texts).encode("utf-8", "replace") + b"\n"
    every = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(every == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    first = np.concatenate(([0], np.cumsum([t.count("\n") + 1 for t in texts])))
    kinds = CLASSES[every]

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, starts, dtype=np.int64) / np.maximum(of, 1)

    size = ends - starts
    word_at, word = hash_words(data, BLANK)
    line = np.searchsorted(starts, word_at, "right") - 1
    words = np.bincount(line, minlength=len(starts))
    bounds = np.searchsorted(line, np.arange(len(starts) + 1))
    symbol_end = np.zeros(len(every), bool)
    symbol_end[:-1] = (kinds[:-1] == SYMBOL) & (kinds[1:] == GAP)
    echo = (word[1:] == word[:-1]) & (line[1:] == line[:-1])
    kind_of = mix(word + line.astype(_U) * _U(0x9E3779B97F4A7C15))
    distinct = np.bincount(line[np.unique(kind_of, return_index=True)[1]], minlength=len(starts))
    place = np.arange(len(word)) - bounds[line]
    sums = np.concatenate(([_U(0)], np.cumsum(mix(word + place.astype(_U) * _U(0xBF58476D1CE4E5B9)), dtype=_U)))
    text_of = np.repeat(np.arange(len(texts)), np.diff(first))
    whole = mix(sums[bounds[1:]] - sums[bounds[:-1]] + text_of.astype(_U) * _U(0x94D049BB133111EB))
    seen = np.ones(len(starts), bool)
    seen[np.unique(whole, return_index=True)[1]] = False
    out = np.column_stack([
        np.log1p(size),
        np.log1p(words),
        share(kinds == UPPER, size),
        share(kinds == DIGIT, size),
        share(kinds == MARK, size),
        share(kinds == SYMBOL, size),
        share(symbol_end, words),
        size / np.maximum(words, 1),
        share(kinds == GAP, size + 1),
        np.bincount(line[1:][echo], minlength=len(starts)) / np.maximum(words, 1),
        distinct / np.maximum(words, 1),
        seen & (words > 0),
        np.log1p(np.diff(first))[text_of],
    ])
    return out.astype(np.float32), first


@dataclass
class Model:
    """Bin edges of each measure, weights by place (before, own, after), measure and bin, and the transitions.

    ``turn`` holds the weights of good after good, good after bad, bad after good; bad after bad is 0.
    """

    edges: list[np.ndarray]
    weights: np.ndarray
    turn: np.ndarray

    def binned(self, lines: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, lines.T, strict=True)])


def neighbours(bins: np.ndarray, first: np.ndarray, absent: int) -> np.ndarray:
    """The bins of the line before, the line itself and the line after; ``absent`` beyond a text's ends."""
    before = np.full_like(bins, absent)
    after = np.full_like(bins, absent)
    before[1:], after[:-1] = bins[:-1], bins[1:]
    before[first[:-1]] = absent
    after[first[1:] - 1] = absent
    return np.stack([before, bins, after], axis=1)


def emissions(cells: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """How much each line speaks for good rather than bad."""
    places, measures = weights.shape[:2]
    return sum(weights[p, m][cells[:, p, m]] for p in range(places) for m in range(measures))


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def chains(first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts of about equally many lines together: the line numbers, one row a text, and which are real."""
    count = np.diff(first)
    groups = np.ceil(np.log2(np.maximum(count, 1))).astype(int)
    for g in np.unique(groups):
        own = np.flatnonzero(groups == g)
        step = np.arange(count[own].max())
        real = step < count[own, None]
        yield np.where(real, first[own, None] + step, 0), real


def forward_backward(
    scores: np.ndarray, first: np.ndarray, turn: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each line's chance of good; each line's chance of the three weighted turns into it; each text's partition.

    Scores are logarithms of good against bad, so a state is one number where two would do.  The
    last result gives for every line what it adds to the logarithm of its text's partition.
    """
    gg, gb, bg = turn  # gb: good after bad
    good, turns, added = np.zeros(len(scores)), np.zeros((len(scores), 3)), np.zeros(len(scores))
    for at, real in chains(first):
        s = np.where(real, scores[at], 0.0)
        steps = s.shape[1]
        fore_g, fore_b = np.zeros_like(s), np.zeros_like(s)
        back_g, back_b = np.zeros_like(s), np.zeros_like(s)
        scale = np.zeros_like(s)
        for t in range(steps):
            if t == 0:
                a, b = s[:, 0], np.zeros(len(s))
            else:
                a = s[:, t] + _log_add(fore_g[:, t - 1] + gg, fore_b[:, t - 1] + gb)
                b = _log_add(fore_g[:, t - 1] + bg, fore_b[:, t - 1])
            scale[:, t] = _log_add(a, b)
            fore_g[:, t], fore_b[:, t] = a - scale[:, t], b - scale[:, t]
        for t in range(steps - 2, -1, -1):
            next_g, next_b = s[:, t + 1] + back_g[:, t + 1], back_b[:, t + 1]
            a = _log_add(gg + next_g, bg + next_b)
            b = _log_add(gb + next_g, next_b)
            on = real[:, t + 1]
            back_g[:, t] = np.where(on, a - scale[:, t + 1], 0.0)
            back_b[:, t] = np.where(on, b - scale[:, t + 1], 0.0)
        lines = at[real]
        good[lines] = np.exp(np.minimum(fore_g + back_g, 0.0))[real]
        added[lines] = scale[real]
        if steps > 1:
            into = real[:, 1:]
            here = back_g[:, 1:] + s[:, 1:] - scale[:, 1:]
            ways = (fore_g[:, :-1] + gg + here, fore_b[:, :-1] + gb + here,
                    fore_g[:, :-1] + bg + back_b[:, 1:] - scale[:, 1:])
            for k, way in enumerate(ways):
                turns[at[:, 1:][into], k] = np.exp(np.minimum(way, 0.0))[into]
    return good, turns, added


def _minimum(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int) -> np.ndarray:
    """A minimum of a smooth convex function by limited-memory BFGS with step halving."""
    value, slope = f(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = slope.copy(), []
        for s, y, rho in reversed(moves):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * y
        if moves:
            s, y, rho = moves[-1]
            q *= 1 / (rho * (y @ y))
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, y, rho), alpha in zip(moves, reversed(alphas), strict=True):
            q += s * (alpha - rho * (y @ q))
        step = 1.0
        while step > 1e-6:
            new_value, new_slope = f(x - step * q)
            if new_value <= value - 1e-4 * step * (slope @ q):
                break
            step /= 2
        else:
            break
        s, y = -step * q, new_slope - slope
        x = x + s
        if s @ y > 1e-12:
            moves = [*moves[-9:], (s, y, 1 / (s @ y))]
        done = abs(value - new_value) <= 1e-7 * max(1.0, abs(value))
        value, slope = new_value, new_slope
        if done:
            break
    return x


def fit(lines: np.ndarray, first: np.ndarray, quality: np.ndarray, weight: np.ndarray) -> Model:
    """A chain fitted to texts whose lines all carry the text's label; ``weight`` is each text's."""
    text_of = np.repeat(np.arange(len(quality)), np.diff(first))
    is_good, share = quality[text_of] == 1, weight[text_of]
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique([np.quantile(c[is_good == k], cuts) for k in (False, True)]) for c in lines.T]
    model = Model(edges, np.zeros((3, lines.shape[1], 2 * BINS)), np.zeros(3))
    cells = neighbours(model.binned(lines), first, 2 * BINS - 1)
    inner = np.ones(len(lines), bool)
    inner[first[:-1]] = False  # lines that another line of their text stands before
    shape = model.weights.shape
    flat = [np.ravel(cells[:, p, m] + (p * shape[1] + m) * shape[2]) for p in range(3) for m in range(shape[1])]
    held = np.full(model.weights.size + 3, RIDGE)
    held[-3:] = 0.01

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, turn = x[:-3].reshape(shape), x[-3:]
        scores = emissions(cells, w)
        good, turns, added = forward_backward(scores, first, turn)
        own = np.where(is_good, scores + np.where(inner, turn[0], 0.0), 0.0)
        value = float((share * (added - own)).sum() + 0.5 * (held * x * x).sum())
        off = share * (good - is_good)
        slope = held * x
        for cell in flat:
            slope[:-3] += np.bincount(cell, off, model.weights.size)
        slope[-3:] += (share[:, None] * turns).sum(axis=0)
        slope[-3] -= (share * (is_good & inner)).sum()
        return value, slope

    found = _minimum(loss, np.zeros(model.weights.size + 3), STEPS)
    return Model(edges, found[:-3].reshape(shape), found[-3:])


def scores_of(texts: list[str], model: Model | None) -> np.ndarray:
    """Each text's quality: the chance of good of its lines, weighted by their bytes."""
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    lines, first = measured_lines(texts)
    cells = neighbours(model.binned(lines), first, 2 * BINS - 1)
    good = forward_backward(emissions(cells, model.weights), first, model.turn)[0]
    size = np.expm1(lines[:, 0].astype(float)) + 1
    return np.clip(np.add.reduceat(good * size, first[:-1]) / np.add.reduceat(size, first[:-1]), 0.0, 1.0)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Callable[[Column], Column] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    per_label: int = SAMPLE_PER_LABEL,
    max_lines: int = SAMPLE_LINES,
) -> Model | None:
    """A model from the labelled documents whose id ``learn_from`` accepts; None without both labels.

    The sample is taken by a hash of the id before any text is read: ``per_label`` documents of
    each label at most, and of these the ones of ``max_lines`` lines at most.
    """
    known = only(labels, doc_id=doc_id, quality=label).filter("doc_id is not null and quality in (0, 1)")
    if learn_from:
        known = known.filter(learn_from(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    totals = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}  # two at most
    sample = cut(sampled(known.withColumn("h", F.xxhash64("doc_id")), "quality", "h", per_label, 2).drop("h"), "sample")
    short = only(docs, doc_id=doc_id, text=text).filter(
        F.col("text").isNotNull() & (F.length(F.regexp_replace("text", "[^\n]+", "")) < max_lines)
    )
    found = short.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in in_blocks([len(t) for t in texts], BLOCK):
                lines, first = measured_lines(texts[part])
                rows = [lines[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                own = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("quality"), pa.array(rows, pa.binary())],
                    ["doc_id", "quality", "lines"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    measured = found.mapInArrow(lean(run), f"doc_id {kind}, quality int, lines binary")
    rows = sorted(measured.collect(), key=lambda r: r["doc_id"])  # the bounded sample's measures
    quality = np.array([r["quality"] for r in rows], int)
    if len(set(quality.tolist())) < 2:
        return None
    each = [np.frombuffer(r["lines"], np.float32).reshape(-1, len(MEASURES)) for r in rows]
    first = np.concatenate(([0], np.cumsum([len(e) for e in each])))
    # Both labels weigh as much as in the whole of the labelled documents.
    share = np.array([totals[q] / sum(totals.values()) / (quality == q).mean() for q in (0, 1)])
    return fit(np.concatenate(each), first, quality, share[quality])


def score_of(model: Model | None) -> Callable[[Column], Column]:
    """A column function: text to quality."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values = [t or "" for t in texts.to_pylist()]
            out = [scores_of(values[part], model) for part in in_blocks([len(t) for t in values], BLOCK)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return arrow_udf(lean(run), "double").asNondeterministic()


def line_quality(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score; one row per document."""
    return only(docs, doc_id=doc_id, text=text).select("doc_id", score_of(model)(F.col("text")).alias("score"))
