"""Language identification by compression.

Each language gets a dictionary of raw text from a bounded sample of labelled documents.  A
text is compressed by zstandard with every language's dictionary; the language whose
dictionary leaves the fewest bytes wins, and its lead over the second is the margin.  Narrow
margins are rejected (``accepted`` is false), the guess is still returned.

Defined results: a text that is null, empty or without any letter is ``und`` with score 0.
Equal sizes go to the first language by name.  With no labelled row everything is ``und``;
with one language, all texts with a letter are of that language.  Labels that are null or
empty are not learned.  Repeated rows are judged row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from flowscope.llm.tables import only, sampled

UNKNOWN = "und"
# What a language's dictionary is cut from: at most so many documents, and so many characters each.
SAMPLE_DOCUMENTS = 256
DOCUMENT_CHARS = 1024
LEVEL = 3
# Texts are compressed in pieces no longer than this, so that memory is bounded.
PIECE = 1 << 16
MIN_MARGIN = 0.02
FULL_MARGIN = 0.2
MAX_LANGUAGES = 512
_LETTER = regex.compile(r"\p{L}")
_NOT_LETTERS = regex.compile(r"\P{L}+")


def _words(text: str) -> bytes:
    """Lower-case words, single spaces around: digits, marks and layout say nothing of a language."""
    return (" " + _NOT_LETTERS.sub(" ", text).strip() + " ").lower().encode()


def learn(
    labelled: DataFrame,
    learn_from: Column | None = None,
    text: str = "text",
    lang: str = "lang",
    order: str | None = None,
    documents: int = SAMPLE_DOCUMENTS,
) -> dict[str, bytes]:
    """Raw-content dictionaries by language, from at most ``documents`` texts of each.

    Which texts are taken follows from a hash of ``order`` (the text itself by default), so it
    does not depend on how rows are stored.  The result is a few hundred KiB a language.
    """
    rows = labelled if learn_from is None else labelled.filter(learn_from)
    picked = only(rows, text=text, lang=lang, by=order or text).filter(
        "lang is not null and lang != '' and text is not null and text != ''"
    )
    # A long text gives one stretch, at a place that its hash picks.
    start = F.pmod(F.xxhash64("by", F.lit(1)), F.greatest(F.length("text") - DOCUMENT_CHARS, F.lit(1))).cast("int") + 1
    hashed = picked.select(
        "lang", F.xxhash64("by").alias("h"), F.substring("text", start, F.lit(DOCUMENT_CHARS)).alias("stretch")
    )
    sample = sampled(hashed, "lang", "h", min(documents, SAMPLE_DOCUMENTS), MAX_LANGUAGES)
    dictionaries: dict[str, list[str]] = {}
    for row in sample.sort("lang", "h", "stretch").collect():  # bounded by languages and documents
        dictionaries.setdefault(row["lang"], []).append(row["stretch"])
    return {k: b"".join(map(_words, v)) for k, v in dictionaries.items()}


class Classifier:
    """Compressors by language; sizes of a text under each."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.compressors = []
        for content in dictionaries.values():
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False)
            )

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin; the margin is the bytes saved over the second, by the second's."""
        if not text or not _LETTER.search(text) or not self.names:
            return UNKNOWN, 0.0, 0.0
        sizes = np.zeros(len(self.names))
        # Pieces of whole characters; each is normalised by itself, so that memory stays bounded.
        for at in range(0, len(text), PIECE):
            piece = _words(text[at : at + PIECE])
            sizes += [len(c.compress(piece)) for c in self.compressors]
        if len(sizes) == 1:
            return self.names[0], 1.0, 1.0
        best = int(sizes.argmin())
        second = np.delete(sizes, best).min()
        margin = float((second - sizes[best]) / second)
        return self.names[best], min(1.0, 0.5 + margin / (2 * FULL_MARGIN)), margin


def classify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    doc_id: str = "doc_id",
    text: str = "text",
    min_margin: float = MIN_MARGIN,
) -> DataFrame:
    """doc_id, lang_pred, score, margin, accepted; one row per document, whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded by ``learn``

    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classifier = Classifier(shared.value)
        for texts in batches:
            rows = [classifier.judge(t) for t in texts.to_pylist()]
            names, scores, margins = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())],
                ["lang_pred", "score", "margin"],
            )

    judge: Callable = arrow_udf(judged, "lang_pred string, score double, margin double").asNondeterministic()
    rows = only(docs, doc_id=doc_id, text=text).select("doc_id", judge(F.col("text")).alias("j"))
    return rows.select("doc_id", "j.*").withColumn(
        "accepted", (F.col("lang_pred") != UNKNOWN) & (F.col("margin") >= min_margin)
    )
