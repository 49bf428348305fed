"""Best-fit packing of tokenized documents into sequences of a fixed length.

Documents are tokenized and cut into pieces.  Pieces are dealt into shards at random, each
shard is packed best-fit decreasing and improved by a local search over its underfull bins:
move a document, exchange one for one, or two for one, whenever the sum of squared fills
grows, until bins empty.  What is left in underfull bins of all shards is dealt and packed
anew until one shard holds it.

Defined results: a null or empty text is one end token.  Repeated rows are packed row by
row.  Equal lengths are told apart by the order of pieces in storage.  An empty table gives
an empty result.  Only texts longer than a sequence are cut.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowscope.llm.hashing import in_blocks
from flowscope.llm.tables import cut, fresh, lean, only

SHARD_PIECES = 25_000
BLOCK = 1 << 20
KNOWN_RUNS = 600_000
KNOWN_WORDS = 400_000
SHORT = 7
# Runs encoded at a time: the library's results are much larger than the ids taken from them.
ENCODED = 10_000
JOINED = 200
UNDERFULL = 0.985
# Turns of dealing; a turn's number takes five bits of the sequence ids.
MAX_TURNS = 31
# Blanks to str.split() that this library's \s leaves inside words.
_SEPARATOR_CONTROLS = "\x1c\x1d\x1e\x1f"
# How a tokenizer has to cut normalized runs into words for its words to be kept too.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
NORMAL = ["NFC", "Replace", "Lowercase"]
# The same for characters up to the end of Latin Extended-B, whose classes are settled; the
# numbers among them that are no digits are named.  Other runs are left to the tokenizer whole.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")
_UNSETTLED = re.compile(r"[\x1c-\x1f\u0130\u0250-\U0010ffff]|<\|")


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def _settled(text: str) -> bool:
    try:
        text.encode("latin-1")  # much faster than the search, and enough for most texts
    except UnicodeEncodeError:
        return not _UNSETTLED.search(text)
    return "<|" not in text and not any(c in text for c in _SEPARATOR_CONTROLS)


def _cuts_words(tokenizer: Tokenizer) -> bool:
    """Whether the tokenizer lower-cases runs and cuts them by ``WORDS``."""
    told = json.loads(tokenizer.to_str())
    normal, cut = told["normalizer"] or {}, told["pre_tokenizer"] or {}
    first = cut.get("pretokenizers", [{}])[0]
    return (
        [n["type"] for n in normal.get("normalizers", [])] == NORMAL
        and first.get("pattern") == {"Regex": WORDS}
        and (first.get("behavior"), first.get("invert")) == ("Removed", True)
        and told["model"].get("end_of_word_suffix") == WORD_END
        and all(a["special"] and a["content"].startswith("<|") for a in told["added_tokens"])
    )


class Ids:
    """Token ids of texts as little-endian 32-bit bytes, each white-space delimited run once.

    Only for tokenizers that drop white space and split at it: then a text's ids are those
    of its runs in a row.  Where the tokenizer's way of cutting runs into words is known, a run's
    ids are those of its words, and each word is tokenized once; what else the tokenizer does,
    it does itself.  What is kept is bounded; when there is more, the long is forgotten and
    tokenized again.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] | None = {} if _cuts_words(self.tokenizer) else None
        self.closing = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
        self.closing[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(WORD_END)]] = True
        probe = "a bc\n\n d.e\tf"
        if self._encode([probe])[0] != b"".join(self._encode(probe.split())):
            raise ValueError("this tokenizer's ids depend on white space")

    def _encode(self, runs: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(runs), ENCODED):
            encoded = self.tokenizer.encode_batch_fast(runs[at : at + ENCODED], add_special_tokens=False)
            lists = [e.ids for e in encoded]
            data = np.array(list(chain.from_iterable(lists)), "<u4").tobytes()
            ends = np.cumsum([4 * len(x) for x in lists]).tolist()
            out += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words, many of them tokenized as one string: each ends with a token that ends a word."""
        out = []
        for at in range(0, len(words), ENCODED):
            part = words[at : at + ENCODED]
            strings = [" ".join(part[k : k + JOINED]) for k in range(0, len(part), JOINED)]
            encoded = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
            flat = np.fromiter(chain.from_iterable(e.ids for e in encoded), "<u4")
            ends = (4 * np.flatnonzero(self.closing[flat]) + 4).tolist()
            if len(ends) != len(part):
                out += self._encode(part)
                continue
            data = flat.tobytes()
            out += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def _runs(self, runs: list[str]) -> list[bytes]:
        if self.words is None:
            return self._encode(runs)
        if len(self.words) > KNOWN_WORDS:
            self.words = _without_long(self.words, KNOWN_WORDS)
        joined = "\n".join(runs)
        if not _settled(joined):
            whole = [i for i, r in enumerate(runs) if not _settled(r)]
            out = dict(zip(whole, self._encode([runs[i] for i in whole]), strict=True))
            rest = [r for i, r in enumerate(runs) if i not in out]
            others = iter(self._runs(rest) if rest else [])
            return [out[i] if i in out else next(others) for i in range(len(runs))]
        cut = list(map(_WORD.findall, joined.lower().split("\n"))) if runs else []
        new = list(set(chain.from_iterable(cut)).difference(self.words))
        self.words.update(zip(new, self._words(new), strict=True))
        get = self.words.__getitem__
        return [get(words[0]) if len(words) == 1 else b"".join(map(get, words)) for words in cut]

    def texts(self, block: list[str]) -> Iterator[bytes]:
        split = [[t] if any(c in t for c in _SEPARATOR_CONTROLS) else t.split() for t in block]
        if len(self.known) > KNOWN_RUNS:
            self.known = _without_long(self.known, KNOWN_RUNS)
        new = list(set(chain.from_iterable(split)).difference(self.known))
        self.known.update(zip(new, self._runs(new), strict=True))
        get = self.known.__getitem__
        for runs in split:
            yield b"".join(map(get, runs))

    def forget(self) -> None:
        """Drops all runs and words: a worker lives on through stages that need the room."""
        self.known.clear()
        if self.words is not None:
            self.words.clear()


def _without_long(known: dict[str, bytes], most: int) -> dict[str, bytes]:
    """Keeps the short ones, which come again most often, unless they are too many themselves."""
    short = {k: v for k, v in known.items() if len(k) <= SHORT}
    return short if len(short) <= most // 2 else {}


@lru_cache(maxsize=1)
def _ids(path: str) -> Ids:
    """One a worker, so that later tasks need not load the tokenizer again."""
    return Ids(path)


PIECES = "doc_id {id_type}, piece int, start long, length long, ids_crc32 long{ids}, place long"


def _pieces(path: str, length: int, end_id: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(path)
        end = np.array([end_id], "<u4").tobytes()
        place = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in in_blocks([len(t) for t in texts], BLOCK):
                rows = []
                for i, got in enumerate(ids.texts(texts[part]), part.start):
                    got += end
                    for at in range(0, len(got), 4 * length):
                        own = got[at : at + 4 * length]
                        rows.append((i, at // (4 * length), at // 4, len(own) // 4, zlib.crc32(own), own))
                of, piece, start, size, crc, own = zip(*rows, strict=True)
                columns = [batch.column(0).take(pa.array(of)), pa.array(piece, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (start, size, crc)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in own], pa.list_(pa.int32())))
                    names.append("ids")
                columns.append(pa.array(range(place, place + len(rows)), pa.int64()))
                place += len(rows)
                yield pa.RecordBatch.from_arrays(columns, [*names, "place"])
        ids.forget()

    return run


def tokenized_pieces(
    docs: DataFrame,
    tokenizer: str,
    length: int,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (, ids), place; one row per piece.

    ``place`` numbers the pieces.  It holds for one evaluation: write the result before use.
    """
    source = only(docs, doc_id=doc_id, text=text)
    id_type = source.schema["doc_id"].dataType.simpleString()
    schema = PIECES.format(id_type=id_type, ids=", ids array<int>" if with_ids else "")
    return source.mapInArrow(lean(_pieces(tokenizer, length, end_id, with_ids)), schema)


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of item numbers: the largest item first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted rooms that some bin has
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            bins.append([item])
            here, left = len(bins) - 1, length - size
        else:
            room = rooms[at]
            here, left = by_room[room].pop(), room - size
            if not by_room[room]:
                rooms.pop(at)
            bins[here].append(item)
        if left:
            if not by_room.get(left):
                bisect.insort(rooms, left)
                by_room[left] = []
            by_room[left].append(here)
    return bins


def _best_exchange(donor: list[int], room: int, other: list[int], sizes: list[int]) -> tuple[int, tuple, tuple]:
    """The most that ``other`` can gain by taking one or two of ``donor`` for at most one of its own.

    Takes room into account; returns (gain, items given, items taken back), gain 0 for none.
    """
    given = sorted((sizes[i], (i,)) for i in donor)
    given += [(sizes[a] + sizes[b], (a, b)) for k, a in enumerate(donor) for b in donor[k + 1 :]]
    given.sort()
    totals = [g[0] for g in given]
    best: tuple[int, tuple, tuple] = (0, (), ())
    for back in [None, *other]:
        freed = sizes[back] if back is not None else 0
        at = bisect.bisect_right(totals, room + freed) - 1
        if at >= 0 and totals[at] - freed > best[0]:
            best = (totals[at] - freed, given[at][1], () if back is None else (back,))
    return best


def improve(bins: list[list[int]], sizes: list[int], length: int, tries: int = 64, passes: int = 20) -> list[list[int]]:
    """Local search over underfull bins; never more bins than before.

    A step takes g tokens from a bin of fill A to one of fill B when B + g > A: then the sum
    of squared fills grows, so the search ends.  Bins below ``UNDERFULL`` give, the emptiest
    first; a bin meets the ``tries`` partners with the most room and offers its ``tries``
    largest documents.  ``passes`` bounds the work, not the result's validity.
    """
    fills = [sum(sizes[i] for i in b) for b in bins]
    for _ in range(passes):
        improved = False
        donors = sorted((k for k, f in enumerate(fills) if 0 < f < UNDERFULL * length), key=fills.__getitem__)
        partners = sorted((k for k, f in enumerate(fills) if 0 < f < length), key=fills.__getitem__)
        for donor in donors:
            met = 0
            for k in partners:
                if k == donor or not 0 < fills[k] < length:
                    continue
                if met == tries or not bins[donor]:
                    break
                met += 1
                offered = sorted(bins[donor], key=lambda i: -sizes[i])[:tries]
                gain, give, back = _best_exchange(offered, length - fills[k], bins[k], sizes)
                if gain > max(0, fills[donor] - fills[k]):
                    bins[donor] = [i for i in bins[donor] if i not in give] + list(back)
                    bins[k] = [i for i in bins[k] if i not in back] + list(give)
                    fills[k] += gain
                    fills[donor] -= gain
                    improved = True
        if not improved:
            break
    return [b for b in bins if b]


def _pack_shard(length: int, base: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("place", ignore_index=True)
        sizes = shard["length"].tolist()
        bins = improve(best_fit(sizes, length), sizes, length)
        number = (base << 58) + (int(shard["shard"].iloc[0]) << 26)
        sequence, offset, fill = (np.zeros(len(sizes), np.int64) for _ in range(3))
        for n, b in enumerate(bins):
            at = 0
            for i in sorted(b):
                sequence[i], offset[i] = number + n, at
                at += sizes[i]
            fill[b] = at
        return pd.DataFrame({"place": shard["place"], "length": shard["length"], "sequence_id": sequence, "offset": offset, "fill": fill})

    return run


PACKED = "place long, length long, sequence_id long, offset long, fill long"


def pack(pieces: DataFrame, length: int, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """place, sequence_id, offset of every row of ``pieces`` (place, length <= ``length``).

    ``pieces`` must be stored.  Shards are sized by ``shard_pieces``, however many there are.
    """
    full = pieces.filter(F.col("length") == length).select(
        "place", F.col("place").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    parts, left = [full], pieces.filter(F.col("length") < length).select("place", "length")
    count = left.count()
    for turn in range(1, MAX_TURNS + 1):
        shards = max(1, -(-count // shard_pieces))
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("place", F.lit(turn)), F.lit(shards)))
        packed = cut(dealt.groupBy("shard").applyInPandas(_pack_shard(length, turn), PACKED), "packed")
        done = F.col("fill") >= UNDERFULL * length
        again = packed.filter(~done)
        before, count = count, again.count()
        # One shard has seen all that was left; or nothing fits together any more; or no turn is left.
        last = shards == 1 or count > 0.9 * before or not count or turn == MAX_TURNS
        parts.append((packed if last else packed.filter(done)).select("place", "sequence_id", "offset"))
        if last:
            break
        left = again.select("place", "length")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def packed_documents(
    docs: DataFrame,
    tokenizer: str,
    length: int = 4096,
    end_id: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (, ids), sequence_id, offset; one row per piece."""
    pieces = cut(tokenized_pieces(docs, tokenizer, length, end_id, doc_id, text, with_ids), "pieces")
    return pieces.join(pack(pieces, length), "place").drop("place")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, documents; the token ids of every sequence, from ``packed_documents(with_ids=True)``.

    ``documents`` lists (doc_id, piece, offset, length) in order; a group is one sequence.
    """
    item = fresh(packed, "item")
    row = F.struct("offset", "doc_id", "piece", "length", "ids")
    ordered = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(row)).alias(item))
    return ordered.select(
        "sequence_id",
        F.flatten(F.transform(item, lambda x: x["ids"])).alias("ids"),
        F.transform(item, lambda x: x.dropFields("ids")).alias("documents"),
    )
