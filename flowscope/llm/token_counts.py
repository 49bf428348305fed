"""Token counts by distinct pre-token.

A byte-level BPE never merges across pre-tokens, so a text's token count is a sum over its
pre-tokens, and each distinct pre-token needs to be tokenized once.  Texts are read once and
become lists of pre-token numbers with frequencies, numbered within a chunk of documents.
The chunks' vocabularies meet by pre-token, each is tokenized once, and its piece count
goes back to the chunks that have it, where it is joined to the documents' frequencies.  No ids of texts are ever built, no vocabulary is
broadcast, and every group is bounded by the chunk size.

Defined results: a null or empty text has 0 bytes and 0 tokens.  The strings of special
tokens inside a text count one token each, as in the library's default.  Repeated rows are
counted row by row.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowscope.llm.hashing import in_blocks
from flowscope.llm.tables import cut, lean, only

CHUNK_BYTES = 64 << 20
# More pre-tokens than a chunk can have.
VOCABULARY_BITS = 27
MAX_VOCABULARY = 1 << VOCABULARY_BITS
_GAP, _MOST = 0xFFFF, 0xFF
# How byte-level BPE splits texts before merging; fixed values of the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Unicode White_Space.
SPACE = "\t-\r \x85\xa0  -     　"
_RUN = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_PRE_TOKEN = regex.compile(PATTERN)
# Below this, letters and digits are the same in every Unicode version.
_SETTLED = "ɐ"


@lru_cache(maxsize=4)
def load(path: str) -> tuple[Tokenizer, tuple[str, ...]]:
    """A byte-level BPE tokenizer whose special strings are plain text, and those strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or not plain:
        raise ValueError("only byte-level BPE without a normalizer can be counted by pre-token")
    if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take in their surroundings are not supported")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer, tuple(sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True))


def pre_tokens(run: str, tokenizer: Tokenizer) -> list[str]:
    """The pre-tokens of a text without special strings."""
    if max(run) < _SETTLED:
        return _PRE_TOKEN.findall(run)
    return [run[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(run)]


def packed(numbers: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted numbers as 16-bit gaps and their counts as bytes.

    A gap of 65535 or more is that many fillers of 65535 first; a count above 255 repeats its number.
    """
    times = (counts + _MOST - 1) // _MOST
    last = np.cumsum(times) - 1
    small = np.full(int(times.sum()), _MOST, np.uint8)
    small[last] = counts - (times - 1) * _MOST
    gaps = np.diff(np.repeat(numbers.astype(np.int64), times), prepend=0)
    steps = gaps // _GAP + 1
    out = np.full(int(steps.sum()), _GAP, np.uint16)
    out[np.cumsum(steps) - 1] = gaps % _GAP
    return out.tobytes(), small.tobytes()


def unpacked(gaps: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps = np.frombuffer(gaps, np.uint16).astype(np.int64)
    return np.cumsum(steps)[steps != _GAP], np.frombuffer(counts, np.uint8).astype(np.int64)


class Chunk:
    """Pre-tokens numbered in order of first sight, and each document's frequencies."""

    def __init__(self, path: str):
        self.tokenizer, specials = load(path)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.numbers: dict[str, int] = {}
        # White-space delimited runs come again and again: each is split once a chunk.
        self.runs: dict[str, bytes] = {}

    def _number(self, token: str) -> int:
        return self.numbers.setdefault(token, len(self.numbers))

    def _run(self, run: str) -> bytes:
        out = np.array([self._number(t) for t in pre_tokens(run, self.tokenizer)], np.int32).tobytes()
        self.runs[run] = out
        return out

    def document(self, text: str) -> tuple[bytes, bytes, int]:
        """Packed numbers, their frequencies, and how many special strings were found."""
        specials = 0
        segments = [text]
        if self.special and self.special.search(text):
            segments = self.special.split(text)
            specials = len(segments) - 1
        known = self.runs
        joined = b"".join(
            [known.get(run) or self._run(run) for segment in segments for run in _RUN.findall(segment)]
        )
        numbers, counts = np.unique(np.frombuffer(joined, np.int32), return_counts=True)
        return *packed(numbers, counts), specials


CHUNK_SCHEMA = (
    "chunk long, doc_id {id_type}, n_bytes long, specials long, numbers binary, counts binary, vocabulary array<string>"
)


def _chunks(path: str, chunk_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of documents by chunk; the chunk's first row also has its vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = size = 0
        chunk, ids, rows = Chunk(path), [], []

        def finished() -> pa.RecordBatch:
            n_bytes, numbers, counts, specials = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(TaskContext.get().partitionId() << 12) + made] * len(rows), pa.int64()),
                    pa.concat_arrays(ids),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(specials, pa.int64()),
                    pa.array(numbers, pa.binary()),
                    pa.array(counts, pa.binary()),
                    pa.array([list(chunk.numbers), *[None] * (len(rows) - 1)], pa.list_(pa.string())),
                ],
                ["chunk", "doc_id", "n_bytes", "specials", "numbers", "counts", "vocabulary"],
            )

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in in_blocks([len(t) for t in texts], chunk_bytes):
                rows += [(len(t.encode()), *chunk.document(t)) for t in texts[part]]
                ids.append(batch.column(0).slice(part.start, part.stop - part.start))
                size += sum(map(len, texts[part]))
                if size >= chunk_bytes:
                    yield finished()
                    made += 1
                    size, chunk, ids, rows = 0, Chunk(path), [], []
        if rows:
            yield finished()

    return run


def _pieces(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row's piece count; rows come sorted by token, so a token is tokenized once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, _ = load(path)
        last, last_pieces = None, 0
        for batch in batches:
            tokens = batch.column(1)
            runs = pc.run_end_encode(tokens)
            distinct = runs.values.to_pylist()
            known = int(bool(distinct) and distinct[0] == last)
            encoded = tokenizer.encode_batch_fast(distinct[known:], add_special_tokens=False)
            pieces = np.array([last_pieces] * known + [len(e) for e in encoded], np.int32)
            if distinct:
                last, last_pieces = distinct[-1], int(pieces[-1])
            ends = runs.run_ends.to_numpy()
            spread = np.repeat(pieces, np.diff(ends, prepend=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spread)], ["of", "pieces"])

    return run


def _sum(rows: pa.Table, vocabulary: pa.Table) -> pa.Table:
    """Documents of a chunk with their sums over the chunk's piece counts."""
    pieces = np.zeros(len(vocabulary), np.int64)
    pieces[vocabulary["of"].to_numpy() & (MAX_VOCABULARY - 1)] = vocabulary["pieces"].to_numpy()
    totals = rows["specials"].to_numpy().copy()
    for i, (n, c) in enumerate(zip(rows["numbers"].to_pylist(), rows["counts"].to_pylist(), strict=True)):
        numbers, counts = unpacked(n, c)
        totals[i] += pieces[numbers] @ counts
    return pa.table({"doc_id": rows["doc_id"], "n_bytes": rows["n_bytes"], "n_tokens": totals})


def token_counts(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """doc_id, n_bytes, n_tokens; one row per document.

    ``tokenizer`` is the path of a byte-level BPE in the tokenizers library's format, the same on
    every machine.  ``chunk_bytes`` bounds a chunk's text, save that a document is never cut.
    """
    source = only(docs, doc_id=doc_id, text=text)
    id_type = source.schema["doc_id"].dataType.simpleString()
    # Written once: chunk numbers hold for what was written, and later steps start from it.
    rows = cut(source.mapInArrow(lean(_chunks(tokenizer, chunk_bytes)), CHUNK_SCHEMA.format(id_type=id_type)), "chunks", "zstd")
    # One number for chunk and place: the vocabularies are the bulk of what is shuffled.
    vocabulary = rows.filter("vocabulary is not null").select(
        "chunk", F.posexplode("vocabulary").alias("number", "token")
    ).select((F.col("chunk") * MAX_VOCABULARY + F.col("number")).alias("of"), "token")
    by_token = vocabulary.repartition("token").sortWithinPartitions("token")
    counted = by_token.mapInArrow(_pieces(tokenizer), "of long, pieces int")
    return (
        rows.drop("vocabulary")
        .groupBy("chunk")
        .cogroup(counted.groupBy(F.shiftright("of", VOCABULARY_BITS).alias("chunk_of")))
        .applyInArrow(_sum, f"doc_id {id_type}, n_bytes long, n_tokens long")
    )
