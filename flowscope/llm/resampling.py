"""Importance resampling towards a target: documents drawn by the n-grams they share with it.

Inside tasks Arrow kernels lower-case (``ascii_lower``), split (``split_pattern_regex``), flatten
and dictionary-encode the words.  Dictionary indices shifted by one and two words form the
n-grams; each distinct pair of an n-gram and its next word continues that n-gram's CRC-32 once.
A first pass counts n-grams by hashed bucket over the corpus and the target, which gives each
bucket a gain; a second takes the gains of every document's n-grams and sums them by segment.
Scores are weights with Gumbel noise drawn from the document's id, and the highest are drawn.

Between tasks only bucket counts move, a number of rows that the buckets bound, and one row of
numbers a document for the ranks, which are counted over range partitions.

Defined results: a null or empty text, or one of separators only, has no features, weight 0 and
no rank.  A null id counts as the empty text in the noise, and as the smallest in ties.  Equal
scores go to the smaller id; rows of equal score and id are ranked one after the other, in any
order.  Repeated rows count as often as they occur.  An empty corpus gives an empty result; an
empty target gives gains from the corpus alone.  Texts are worked through in pieces that
overlap by two words, so the longest one needs no more memory than a piece beyond itself.  Only
the two named columns are read, whatever others there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowscope.llm.hashing import in_blocks
from flowscope.llm.tables import cut, lean, only

BUCKETS = 10_000
LONGEST = 3
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # once A-Z are lower-cased
PIECE = 1 << 20
BLOCK = 4 << 20
_SEPARATOR = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@dataclass
class Grams:
    """The n-grams of a block of texts: of each size, every n-gram's distinct one and text, and the buckets."""

    ids: list[np.ndarray]
    texts: list[np.ndarray]
    buckets: list[np.ndarray]


def _pieces(text: str, piece: int) -> Iterator[tuple[str, str]]:
    """``text`` cut between words, each piece with the words after it that its last n-grams reach into."""
    at = 0
    while len(text) - at > piece:
        gap = _SEPARATOR.search(text, at + piece)
        if not gap:
            break
        reach = [m.end() for m in islice(_WORD.finditer(text, gap.end()), LONGEST - 1)]
        yield text[at : gap.start()], text[gap.start() : reach[-1] if reach else gap.end()]
        at = gap.end()
    yield text[at:], ""


def _rows(texts: list[str], piece: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The pieces in a row, each followed by what it reaches into: strings, texts, runs, whether reached into."""
    rows, of, run, reached = [], [], [], []
    for i, text in enumerate(texts):
        for own, after in _pieces(text, piece):
            for part, is_after in ((own, False), (after, True)):
                if part:
                    rows.append(part)
                    of.append(i)
                    run.append(len(of) if not is_after else run[-1])
                    reached.append(is_after)
    return rows, np.array(of, np.int64), np.array(run, np.int64), np.array(reached, bool)


def _encoded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def grams_of(texts: list[str], buckets: int, piece: int = PIECE) -> Grams:
    """The n-grams of 1 to 3 words of all texts, those that begin in a piece counted there."""
    rows, of, run, reached = _rows(texts, piece)
    lists = pc.split_pattern_regex(pc.ascii_lower(pa.array(rows, pa.large_string())), pattern=SEPARATORS)
    words, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.not_equal(words, "")
    at = row.filter(full).to_numpy(zero_copy_only=False)
    word, names = _encoded(words.filter(full))
    of, run, own = of[at], run[at], ~reached[at]
    plain = names.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    after = np.array([b" " + w for w in plain] + [None], object)[:-1]  # continues an n-gram
    crc = np.array([crc32(w) for w in plain], np.int64)
    out = Grams([word[own]], [of[own]], [crc % buckets])
    gram, start = word, np.arange(len(word))  # where each n-gram of the last size begins
    for n in range(1, LONGEST):
        more = start + n < len(word)
        more[more] = run[start[more]] == run[start[more] + n]
        gram, start = gram[more], start[more]
        pair, distinct = _encoded(pa.array(gram * len(plain) + word[start + n]))
        head, tail = np.divmod(distinct.to_numpy(zero_copy_only=False), max(len(plain), 1))
        crc = np.fromiter(map(crc32, after[tail], crc[head].tolist()), np.int64, len(head))
        gram = pair
        begins = own[start]
        out.ids.append(gram[begins])
        out.texts.append(of[start[begins]])
        out.buckets.append(crc % buckets)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        texts = [t or "" for t in batch.column(name).to_pylist()]
        for part in in_blocks([len(t) for t in texts], BLOCK):
            yield batch.slice(part.start, part.stop - part.start), texts[part]


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: the n-grams of column ``text`` by bucket; buckets without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, texts in _blocks(batches, "text"):
            grams = grams_of(texts, buckets)
            for ids, bucket in zip(grams.ids, grams.buckets, strict=True):
                of_distinct = np.bincount(ids, minlength=len(bucket))
                total += np.bincount(bucket, of_distinct, buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    counted = rows.select("text").mapInArrow(lean(run), "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for every bucket, from the counts of corpus and target."""
    s = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    t = target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    none = corpus.sparkSession.range(buckets).select(
        F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")
    )
    both = s.union(t).union(none).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    both = cut(both, "buckets")
    whole = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    wanted = (F.col("t") + 1.0) * F.lit(float(whole["s"] + buckets))
    found = (F.col("s") + 1.0) * F.lit(float(whole["t"] + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(wanted / found)).alias("gain"))


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of rows (doc_id, text)."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _blocks(batches, "text"):
            grams = grams_of(texts, buckets)
            weight, n_features = np.zeros((2, len(texts)), np.int64)
            n_words = np.bincount(grams.texts[0], minlength=len(texts))
            for ids, of, bucket in zip(grams.ids, grams.texts, grams.buckets, strict=True):
                sums = np.concatenate(([0], np.cumsum(gain[bucket].take(ids))))
                ends = np.searchsorted(of, np.arange(len(texts) + 1))
                weight += np.diff(sums[ends])
                n_features += np.diff(ends)
            out = [pa.array(x, pa.int64()) for x in (n_words, n_features, weight)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *out], ["doc_id", "n_words", "n_features", "weight"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_words long, n_features long, weight long"
    return docs.select("doc_id", "text").mapInArrow(lean(run), shape)


def noise(doc_id: Column, seed: int) -> Column:
    """A Gumbel draw in thousandths that depends on seed and id only."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, eligible: str, share_pct: int) -> DataFrame:
    """``scored`` with the ranks of the best ``share_pct`` percent of the rows that are ``eligible``.

    Rows are dealt by ranges of (score, id) and stored, so that a rank is a count of earlier
    ranges, one number each, and a row number inside one.
    """
    # Stored first, as ranges are found by a look at all rows before they are dealt.
    apart = cut(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("row")]
    dealt = apart.repartitionByRange(F.desc(eligible), *order).withColumn("range", F.spark_partition_id())
    dealt = cut(dealt, "ranges")
    sizes = dealt.filter(eligible).groupBy("range").count().collect()  # a number a partition
    before, total, starts = 0, sum(r["count"] for r in sizes), {}
    drawn = share_pct * total // 100
    for range_, n in sorted((r["range"], r["count"]) for r in sizes):
        if before < drawn:
            starts[range_] = before
        before += n
    no_rank = F.lit(None).cast("long").alias("rank")
    reached = F.col(eligible) & F.col("range").isin(list(starts))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    pairs = [x for k, v in starts.items() for x in (F.lit(k), F.lit(v))]
    offset = F.create_map(*pairs)[F.col("range")] if pairs else F.lit(0)
    best = dealt.filter(reached).withColumn("rank", (offset + inside).cast("long"))
    best = best.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return best.unionByName(dealt.filter(~reached).select("*", no_rank)).drop("row", "range")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    buckets: int = BUCKETS,
    min_words: int = 20,
    share_pct: int = 5,
    seed: int = 42,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank; one row per document, rank null where not drawn."""
    own = only(docs, doc_id=doc_id, text=text)
    found = gains(bucket_counts(own, buckets), bucket_counts(only(target, text=target_text), buckets), buckets)
    gain = np.zeros(buckets, np.int64)
    for r in found.collect():  # one number a bucket
        gain[r["bucket"]] = r["gain"]
    scored = weights(own, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = scored.withColumn("long_enough", F.col("n_words") >= min_words)
    return ranked(scored, "long_enough", share_pct).drop("long_enough")
