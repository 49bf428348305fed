"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents are cut into words; documents are searched for runs of
``MATCH`` words that some item has (the seeds, found by running Karp-Rabin hashes).  Documents and
items that share enough seeds are tiled: the longest common run is marked again and again,
never overlapping, until none of ``MATCH`` words is left.  The share of an item's words under
tiles is its coverage, wherever in the document and in whatever order the tiles are.

Defined results: words are runs of letters and digits, lower-cased, and single letters in
scripts without spaces; an item of fewer than
``MATCH`` words is matched as one run of its own length, and one of fewer than ``SHORT`` words only
with a text that has no other words.  Null or empty items and texts match
nothing.  A repeated item or document row counts once; a null id is an id like any
other.  Among equally long runs the first in the item, then in the document, is
marked first.  Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.llm.hashing import NOT_ALNUM, documents_words, in_blocks, prefix_sums, spaced, windows
from flowscope.llm.tables import column, cut, fresh, lean, only

MATCH = 5
# Items of fewer words are matched with whole texts only: words like "Yes." are in many.
SHORT = 3
COVERAGE = 0.6
BLOCK = 8 << 20
# Bits of the map that spares documents the join: fixed, whatever the benchmark's size.
FILTER_BITS = 1 << 24
_U = np.uint64


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return documents_words([spaced(t.lower()).encode() for t in texts], NOT_ALNUM)


def _item_rows(match: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, begin = _tokens([t or "" for t in batch.column(1).to_pylist()])
            tokens = [hashes[a:b] for a, b in zip(begin, begin[1:], strict=False)]
            seeds = [np.unique(windows(t, min(match, len(t)))) if len(t) else t for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([t.tobytes() for t in tokens], pa.binary()),
                    pa.array([min(match, len(t)) for t in tokens], pa.int32()),
                    pa.array([s.view(np.int64) for s in seeds], pa.list_(pa.int64())),
                ],
                ["item_id", "item_tokens", "size", "seeds"],
            )

    return run


def benchmark_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", match: int = MATCH) -> DataFrame:
    """item (a key of the distinct item), item_id, item_tokens, size of its seeds, seeds; stored."""
    source = only(benchmark, item_id=item_id, text=text)
    id_type = source.schema["item_id"].dataType.simpleString()
    rows = source.mapInArrow(_item_rows(match), f"item_id {id_type}, item_tokens binary, size int, seeds array<long>")
    rows = rows.filter("size > 0").dropDuplicates(["item_id", "item_tokens"])
    return cut(rows.withColumn("item", F.xxhash64("item_id", "item_tokens")), "items")


def seed_filter(items: DataFrame) -> tuple[bytes, tuple[int, ...]]:
    """A bit map of the seeds, and the sizes they come in."""
    seeds = items.select(F.explode("seeds").alias("seed")).select(F.pmod("seed", F.lit(FILTER_BITS)).alias("bit"))
    words = seeds.select((F.col("bit") / 64).cast("long").alias("word"), (F.col("bit") % 64).alias("bit"))
    got = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, "<u8")  # two million bytes, whatever there are of seeds
    bits[got["word"].to_numpy()] = got["bits"].to_numpy().view(_U)
    return bits.tobytes(), tuple(sorted(r["size"] for r in items.select("size").distinct().collect()))


def _seen(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents with a seed: their key, seeds, and the words under seeds with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, sizes = shared.value
        bits = np.frombuffer(data, np.uint8)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in in_blocks([len(t) for t in texts], BLOCK):
                hashes, begin = _tokens(texts[part])
                if not len(hashes) or not sizes:
                    continue
                # Windows of the whole block at once; those across documents are put out below.
                found, under = [], np.zeros(len(hashes) + 1, np.int64)
                for size in sizes:
                    seeds = windows(hashes, size)
                    at = seeds & _U(FILTER_BITS - 1)
                    hit = (bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1
                    places = np.flatnonzero(hit)
                    doc = np.searchsorted(begin, places, "right") - 1
                    inside = places + size <= begin[doc + 1]
                    if size < SHORT:
                        inside &= np.diff(begin)[doc] == size
                    places = places[inside]
                    found.append((places, seeds[places]))
                    np.add.at(under, places, 1)
                    np.add.at(under, places + size, -1)
                places = np.concatenate([p for p, _ in found])
                if not len(places):
                    continue
                seeds = np.concatenate([s for _, s in found])
                marked = np.flatnonzero(np.cumsum(under)[:-1] > 0)
                of = np.searchsorted(begin, places, "right") - 1
                marked_of = np.searchsorted(begin, marked, "right") - 1
                rows = np.unique(of)
                own = [np.unique(seeds[of == r]).view(np.int64) for r in rows]
                runs = [marked[marked_of == r] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(pa.array(rows + part.start)) for c in (0, 2)),
                        pa.array(own, pa.list_(pa.int64())),
                        pa.array([hashes[m].tobytes() for m in runs], pa.binary()),
                        pa.array([(m - begin[r]).astype(np.int64).tobytes() for m, r in zip(runs, rows, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "text_hash", "seeds", "doc_tokens", "places"],
                )

    return run


def _left(free: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """How many free words follow each place without a break, its own included."""
    n = len(free)
    ends = np.append(np.flatnonzero(~free | ~joined), n)
    at = np.arange(n)
    return np.where(free, ends[np.searchsorted(ends, at, "right")] - at, 0)


class _Runs:
    """Running hashes of the unmarked words of a document or an item."""

    def __init__(self, words: np.ndarray, joined: np.ndarray):
        self.words, self.joined, self.free = words, joined, np.ones(len(words), bool)
        self.sums, self.down = prefix_sums(words)

    def settle(self, size: int) -> None:
        """Takes note of what is marked; only places before ``size`` unmarked words count from here."""
        self.left = _left(self.free, self.joined)
        self.at = np.flatnonzero(self.left >= size)

    def hashed(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the places that have ``size`` words, and the hashes of these."""
        at = at[self.left[at] >= size]
        return at, (self.sums[at + size] - self.sums[at]) * self.down[at]


def _meet(doc: _Runs, item: _Runs, in_doc: np.ndarray, in_item: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Places in document and item whose next ``size`` words have a hash that the other has, and the hashes."""
    p, of_doc = doc.hashed(in_doc, size)
    i, of_item = item.hashed(in_item, size)
    known = np.isin(of_doc, of_item)
    p, of_doc = p[known], of_doc[known]
    known = np.isin(of_item, of_doc)
    return p, of_doc, i[known], of_item[known]


def tiles(words: np.ndarray, places: np.ndarray, item: np.ndarray, match: int) -> list[tuple[int, int, int]]:
    """(start in item, place in document, words) of each tile, by greedy string tiling.

    ``words`` are words of a document and ``places`` where they stand in it.  The search length
    falls from the longest common run to ``match``.  Each length costs passes over the
    unmarked words: hashes of all runs of that length are differences of prefix sums.  Runs
    with the same hash are marked in order of their places after a comparison of their words.  A place that is
    marked stays marked, so each place is visited once a length.
    """
    runs: list[tuple[int, int, int]] = []
    if match < 1 or not len(words) or not len(item):
        return runs
    a = _Runs(words, np.append(True, np.diff(places) == 1))
    b = _Runs(item, np.ones(len(item), bool))
    most = min(len(words), len(item))
    while most >= match:
        a.settle(match)
        b.settle(match)
        # The longest run: all runs of one length have the shorter ones in them, so halving finds it.
        found = _meet(a, b, a.at, b.at, match)
        low, high = match, most
        if not len(found[0]):
            return sorted(runs)
        while low < high:
            middle = (low + high + 1) // 2
            longer = _meet(a, b, found[0], found[2], middle)
            if len(longer[0]):
                found, low = longer, middle
            else:
                high = middle - 1
        if low == match:
            found = _meet(a, b, found[0], found[2], low)
        _mark(a, b, found, low, places, runs)
        most = low - 1
    return sorted(runs)


def _mark(a: _Runs, b: _Runs, found: tuple[np.ndarray, ...], size: int, places: np.ndarray, runs: list) -> None:
    """Marks common runs of ``size`` words: the first in the item, each with the first free one in the document."""
    in_doc, of_doc, in_item, of_item = found
    order = np.argsort(of_doc, kind="stable")
    in_doc, of_doc = in_doc[order], of_doc[order]
    begin = dict(zip(*(x.tolist() for x in np.unique(of_doc, return_index=True)), strict=True))
    end = {h: n for h, n in zip(begin, [*list(begin.values())[1:], len(of_doc)], strict=True)}
    item_free_from = 0
    for i, h in zip(in_item.tolist(), of_item.tolist(), strict=True):
        if i < item_free_from:
            continue
        at = begin[h]
        # Runs of one length that are free overlap a marked one at an end, if they do.
        while at < end[h] and not (a.free[in_doc[at]] and a.free[in_doc[at] + size - 1]):
            at += 1
        begin[h] = at
        while at < end[h]:
            p = int(in_doc[at])
            if a.free[p] and a.free[p + size - 1] and np.array_equal(a.words[p : p + size], b.words[i : i + size]):
                a.free[p : p + size] = False
                b.free[i : i + size] = False
                runs.append((i, int(places[p]), size))
                item_free_from = i + size
                break
            at += 1


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        out = []
        for doc, places, item, size in zip(
            rows["doc_tokens"], rows["places"], rows["item_tokens"], rows["size"], strict=True
        ):
            words = np.frombuffer(item, _U)
            found = tiles(np.frombuffer(doc, _U), np.frombuffer(places, np.int64), words, size)
            out.append((len(found), sum(n for _, _, n in found), len(words), [[p, n] for _, p, n in found]))
        n, covered, of, spans = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("text_hash"), batch.column("item_id"), pa.array(n, pa.int32()), pa.array(covered, pa.int32()),
                pa.array(of, pa.int32()), pa.array(spans, pa.list_(pa.list_(pa.int64()))),
            ],
            ["doc_id", "text_hash", "item_id", "n_tiles", "covered_words", "item_words", "spans"],
        )


def contaminations(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    match: int = MATCH,
    coverage: float = COVERAGE,
) -> DataFrame:
    """doc_id, text_hash, item_id, n_tiles, covered_words, item_words, spans, coverage of what reaches ``coverage``.

    ``spans`` are the tiles in the document: first word and number of words.  Pairs that
    share too few seeds to reach the coverage even with the shortest tiles are not tiled.
    """
    source = only(docs, doc_id=doc_id, text=text).withColumn("text_hash", F.xxhash64("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    items = benchmark_items(benchmark, item_id, item_text, match)
    item_type = items.schema["item_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(seed_filter(items))
    seen = source.mapInArrow(
        lean(_seen(shared)), f"doc_id {id_type}, text_hash long, seeds array<long>, doc_tokens binary, places binary"
    )
    seen = cut(seen.withColumn("row", F.xxhash64("doc_id", "text_hash")), "seen")
    by_seed = items.select("item", "size", F.size("seeds").alias("n_seeds"), (F.length("item_tokens") / 8).alias("words"), F.explode("seeds").alias("seed"))
    doc_seeds = seen.select("row", "doc_id", F.explode("seeds").alias("seed")).distinct()
    pairs = doc_seeds.join(by_seed, "seed").groupBy("row", "item").agg(
        F.count(F.lit(1)).alias("common"), F.first("size").alias("size"), F.first("words").alias("words"),
        F.first("n_seeds").alias("n_seeds"),
    )
    # Coverage c of w words takes c w / size tiles, each with a seed of its own; an item that
    # repeats itself has fewer distinct seeds, and then one is enough.
    repeats = F.col("words") - F.col("size") + 1 > F.col("n_seeds")
    least = F.when(repeats, 1).otherwise(F.ceil(coverage * F.col("words") / F.col("size")))
    pairs = pairs.filter(F.col("common") >= least).select("row", "item")
    tiled = (
        pairs.join(seen.dropDuplicates(["row"]).drop("seeds"), "row")
        .join(items.drop("seeds"), "item")
        .select("doc_id", "text_hash", "item_id", "doc_tokens", "places", "item_tokens", "size")
        .mapInArrow(
            _tile,
            f"doc_id {id_type}, text_hash long, item_id {item_type}, n_tiles int, covered_words int, item_words int,"
            " spans array<array<long>>",
        )
    )
    return tiled.withColumn("coverage", F.col("covered_words") / F.col("item_words")).filter(F.col("coverage") >= coverage)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text is not contaminated, all columns unchanged.

    A text decides for all rows that have it, whatever their ids.
    """
    numbered = docs.select(column(text).alias("text"), F.xxhash64(column(text)).alias("doc_id"))
    hits = contaminations(numbered, benchmark, **options)
    bad = cut(hits.select(F.col("text_hash").alias(h := fresh(docs, "contaminated"))).distinct(), "contaminated")
    return docs.join(bad, F.xxhash64(column(text)) == column(h), "left_anti")
