"""Toxicity scores from a weighted lexicon.

Texts are folded (case, styled letters, homoglyphs, invisible characters, digits and marks
standing for letters) and matched as they are and with their accents taken off; a lexicon of word
beginnings is matched by an Aho-Corasick automaton, hits inside exception phrases do not
count, and the summed weights, by themselves and normalised by length, give a probability.
Lexicon, exceptions and the two coefficients are learned from a bounded sample of labelled
documents; every text is scored whole.

Defined results: a null or empty text scores as one without hits.  Labels other than 0 and 1
and labels without a document are ignored; a document labelled both ways counts as toxic.
Without any toxic or any clean label the lexicon is empty and every score is 0.  Equal gains
go to the first entry by name.  Repeated rows are scored row by row.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from flowscope.llm.tables import cut, lean, only, sampled

# The sample a model is fitted on: at most so many documents of each label.
SAMPLE_PER_LABEL = 8000
MIN_DOCUMENTS = 4
MIN_LOG_ODDS = 2.0
SHORTEST, LONGEST = 3, 14
MAX_CANDIDATES = 60_000
MAX_ENTRIES = 2_000
MAX_EXCEPTIONS = 20_000

# Letters of other scripts that look like Latin ones; fixed values.
LOOKALIKES = str.maketrans("авеікмнорстухѕјԁԛԝһӏαβεικνορτυχγ", "abeikmhopctyxsjdqwhlabeikvoptuxy")
# Variants that no decomposition leads to a plain letter: strokes, hooks, small capitals.
_VARIANT = re.compile(r"LATIN (?:SMALL LETTER|LETTER SMALL CAPITAL|SMALL LETTER DOTLESS) ([A-Z])(?: WITH .*)?")


def _plain_letters() -> dict[int, str]:
    """One plain letter for each small one with marks or of a varied shape, by decomposition or name."""
    table: dict[int, str] = {}
    for block in (range(0xC0, 0x530), range(0x1D00, 0x1DC0), range(0x1E00, 0x2000), range(0x2C60, 0x2C80), range(0xA720, 0xA800)):
        for point in block:
            base = unicodedata.normalize("NFD", chr(point))[0]
            if found := _VARIANT.fullmatch(unicodedata.name(base, "")):
                base = found[1].lower()
            base = base.translate(LOOKALIKES)
            if base != chr(point):
                table[point] = base
    return table


PLAIN = _plain_letters()
# Digits and marks written for letters; fixed values.
STAND_INS = str.maketrans("013457@$!|", "oieastasil")
_STAND_IN = re.compile(r"(?:(?<=[^\W\d_])[0-9@$!|]+(?=[^\W\d_]))|(?:\b[013457]+(?=[^\W\d_]))|(?:(?<=[^\W\d_])[013457]+\b)")
_BREAK = re.compile(r"[\W_]+")
_UNSEEN = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}]+")


def fold(text: str) -> str:
    """Folded words with single spaces around each; letters keep the accents they are written with."""
    if not text.isascii():
        # Styled and fullwidth letters become usual ones, loose marks and invisible characters go.
        text = unicodedata.normalize("NFKC", text).lower()
        text = _UNSEEN.sub("", unicodedata.normalize("NFC", text)).translate(LOOKALIKES)
    else:
        text = text.lower()
    text = _STAND_IN.sub(lambda m: m[0].translate(STAND_INS), text)
    return " " + _BREAK.sub(" ", text).strip() + " "


def merged(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of half-open spans, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if starts and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


@dataclass
class Model:
    """Weights by word beginning, exception phrases, and intercept and slopes of the score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    coefficients: tuple[float, ...] = ()


class Matcher:
    def __init__(self, model: Model):
        self.model = model
        self.automaton = ahocorasick.Automaton()
        for entry, weight in model.weights.items():
            self.automaton.add_word(" " + entry, (len(entry), weight))
        for phrase in model.exceptions:
            self.automaton.add_word(f" {phrase} ", (-len(phrase), 0.0))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, folded: str) -> Iterator[tuple[int, float]]:
        """Start and weight of every hit outside exception phrases; one a word, the heaviest."""
        if not len(self.automaton):
            return
        best: dict[int, float] = {}
        covered: list[tuple[int, int]] = []
        # As written, and with plain letters for those with accents, which keeps all places.
        for form in (folded,) if folded.isascii() else (folded, folded.translate(PLAIN)):
            for end, (size, weight) in self.automaton.iter(form):
                if size > 0:
                    start = end - size + 1
                    best[start] = max(weight, best.get(start, weight))
                else:
                    covered.append((end + size, end))
        starts, ends = merged(covered)
        for start, weight in best.items():
            at = bisect_right(starts, start) - 1
            if at < 0 or start >= ends[at]:
                yield start, weight

    def features(self, text: str | None) -> tuple[float, float, int]:
        """Logarithms of the hits' weight in a hundred words and in all, and the number of hits."""
        folded = fold(text or "")
        words = max(1, folded.count(" ") - 1)
        found = [w for _, w in self.hits(folded)]
        return math.log1p(100 * sum(found) / words), math.log1p(sum(found)), len(found)

    def score(self, text: str | None) -> tuple[float, int]:
        if not self.model.coefficients:
            return 0.0, 0
        *x, n = self.features(text)
        a, *b = self.model.coefficients
        z = a + sum(p * q for p, q in zip(x, b, strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z)))), n

    def contexts(self, text: str | None) -> set[str]:
        """Each hit's word alone, with the word before, and with the word after."""
        folded = fold(text or "")
        out = set()
        for start, _ in self.hits(folded):
            stop = folded.index(" ", start)
            before = folded.rfind(" ", 0, start - 1) + 1 if start > 1 else start
            after = folded.find(" ", stop + 1)
            out |= {folded[start:stop], folded[before:stop]}
            if after > 0:
                out.add(folded[start:after])
        return out


def beginnings(text: str | None) -> set[str]:
    words = set(fold(text or "").split())
    return {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


def _counted(rows: DataFrame, items: Callable[[str | None], Iterable[str]]) -> DataFrame:
    """item, toxic, clean: the documents of either label that have an item, of (text, toxic) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = Counter(), Counter()
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[toxic].update(items(text))
            every = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(every, pa.string()), *(pa.array([c[i] for i in every], pa.int64()) for c in counts[::-1])],
                ["item", "toxic", "clean"],
            )

    one = rows.mapInArrow(lean(run), "item string, toxic long, clean long")
    return one.groupBy("item").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _lexicon(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Entries by gain, none a beginning of another, with their log odds as weights.

    The gain of an entry is the share of toxic documents it finds less four times the share
    of clean ones, which picks the length at which a word's beginning tells most.
    """
    ranked = []
    for item, (a, c) in counts.items():
        odds = math.log((a + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        gain = a / toxic - 4 * c / clean
        if odds >= MIN_LOG_ODDS and gain > 0:
            ranked.append((-gain, -len(item), item, odds))
    taken: dict[str, float] = {}
    above: set[str] = set()  # beginnings of what is taken
    for _, _, item, odds in sorted(ranked):
        own = [item[:n] for n in range(SHORTEST, len(item) + 1)]
        if item in above or any(o in taken for o in own):
            continue
        taken[item] = odds
        above.update(own)
        if len(taken) == MAX_ENTRIES:
            break
    return taken


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[float, ...]:
    """Intercept and slopes by Newton's method, slopes held to zero by a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, hold = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Callable[[Column], Column] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    per_label: int = SAMPLE_PER_LABEL,
) -> Model:
    """A model from the labelled documents whose id ``learn_from`` accepts, ``per_label`` of each at most.

    Labels are sampled by a hash of the id before any text is read, so what is broadcast and
    what is learned from is bounded whatever the tables' size.
    """
    known = only(labels, doc_id=doc_id, toxic=label).filter("doc_id is not null and toxic in (0, 1)")
    if learn_from:
        known = known.filter(learn_from(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    hashed = known.withColumn("h", F.xxhash64("doc_id"))
    sample = cut(sampled(hashed, "toxic", "h", per_label, 2).drop("h"), "sample")
    train = only(docs, doc_id=doc_id, text=text).join(F.broadcast(sample), "doc_id").select("text", "toxic")
    train = cut(train.filter("text is not null"), "train")
    totals = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Model()
    # Candidates come from toxic documents; clean ones then count those only.
    found = _counted(train.filter("toxic = 1"), beginnings).filter(F.col("toxic") >= MIN_DOCUMENTS)
    toxic = {r["item"]: r["toxic"] for r in found.orderBy(F.desc("toxic"), "item").limit(MAX_CANDIDATES).collect()}
    shared = train.sparkSession.sparkContext.broadcast(frozenset(toxic))
    counted = _counted(train.filter("toxic = 0"), lambda t: beginnings(t) & shared.value)
    clean = {r["item"]: r["clean"] for r in counted.collect()}  # candidates only
    model = Model(_lexicon({k: (v, clean.get(k, 0)) for k, v in toxic.items()}, totals[1], totals[0]))
    phrases = _counted(train, _contexts_of(model))
    innocent = phrases.filter((F.col("clean") >= 3) & (F.col("toxic") * totals[0] < F.col("clean") * totals[1]))
    best = innocent.orderBy(F.desc("clean"), "item").limit(MAX_EXCEPTIONS).collect()
    model.exceptions = frozenset(r["item"] for r in best)
    rows = train.select("toxic", _features_of(model)(F.col("text")).alias("x")).select("toxic", "x.*").collect()
    data = np.array([tuple(r) for r in rows], float)  # two numbers a sampled document
    model.coefficients = _logistic(data[:, 1:3], data[:, 0])
    return model


def _contexts_of(model: Model) -> Callable[[str | None], set[str]]:
    made: list[Matcher] = []

    def contexts(text: str | None) -> set[str]:
        if not made:  # the automaton is built once a task
            made.append(Matcher(model))
        return made[0].contexts(text)

    return contexts


def _struct_udf(model: Model, what: str, names: dict[str, pa.DataType], ddl: str) -> Callable[[Column], Column]:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(model)
        of = getattr(matcher, what)
        for texts in batches:
            rows = [of(t) for t in texts.to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            arrays = [pa.array(c, t) for c, t in zip(columns, names.values(), strict=True)]
            yield pa.StructArray.from_arrays(arrays, list(names))

    return arrow_udf(lean(run), ddl).asNondeterministic()


def _features_of(model: Model) -> Callable[[Column], Column]:
    names = {"per_hundred": pa.float64(), "in_all": pa.float64(), "hits": pa.int64()}
    return _struct_udf(model, "features", names, "per_hundred double, in_all double, hits long")


def score_of(model: Model) -> Callable[[Column], Column]:
    """A column function: text to (score, hits)."""
    return _struct_udf(model, "score", {"score": pa.float64(), "hits": pa.int64()}, "score double, hits long")


def toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, hits; one row per document."""
    rows = only(docs, doc_id=doc_id, text=text)
    return rows.select("doc_id", score_of(model)(F.col("text")).alias("s")).select("doc_id", "s.*")
