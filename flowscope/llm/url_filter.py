"""URL filter from a Bloom filter cascade.

Rules are (host, path beginning) keys with a verdict.  A cascade encodes the listed keys of
one verdict: its first level is a Bloom filter of the listed keys, the second one of the
unlisted keys of the corpus that pass the first, the third one of the listed keys that pass
the second, and so on until no key is left over.  Over the corpus's complete key universe
membership is then exact, without a join of urls and rules: a key passes an odd number of
levels exactly if it is listed.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule.
A url fits a rule if its host is the rule's or a subdomain and its path starts with the
rule's; the longest rule wins, at equal length the one with the longer host.  A rule listed
both ways blocks; rules with a null host, path or verdict are ignored; a rule with an empty
host fits nothing.  Urls that fit no rule get the default verdict.  Repeated rows are judged
row by row.  Without rules or urls nothing is filtered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from flowscope.llm.hashing import mix
from flowscope.llm.tables import cut, only

BLOCK, ALLOW = "block", "allow"
# Bits of a level that one task may hold; lists that need more are cut into segments by hash,
# each with a cascade of its own, and urls are judged segment by segment.
SEGMENT_BITS = 1 << 28
MAX_LEVELS = 64
_U = np.uint64


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def shapes_of(rules: DataFrame) -> list[tuple[int, int]]:
    """(labels of the host, length of the path) of every rule: what of a url can be a key.

    Few whatever the number of rules, as hosts have few labels and listed paths few lengths.
    """
    shapes = rules.select(F.size(F.split("host", r"\.")).alias("l"), F.length("path").alias("p")).distinct()
    return sorted((r["l"], r["p"]) for r in shapes.collect())


def keys_of(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The url's keys of these shapes, longest first; (host, path) structs."""
    labels = F.split(host, r"\.")

    def key(n: int, p: int) -> Column:
        fits = (F.size(labels) >= n) & (F.length(path) >= p) & (host != "")
        suffix = F.substring_index(host, ".", -n)
        return F.when(fits, F.struct(suffix.alias("host"), F.substring(path, 1, p).alias("path")))

    every = F.array(*[key(n, p) for n, p in shapes]) if shapes else F.expr(
        "cast(array() as array<struct<host:string,path:string>>)"
    )

    def by_length(k: Column) -> Column:
        longest = -(F.length(k["host"]) + F.length(k["path"]))
        return F.struct(longest.alias("a"), (-F.length(k["host"])).alias("b"), k.alias("key"))

    ordered = F.sort_array(F.transform(F.filter(every, lambda k: k.isNotNull()), by_length))
    return F.transform(ordered, lambda s: s["key"])


def key_hash(key: Column) -> Column:
    return F.xxhash64(key["host"], F.lit("/"), key["path"])


@dataclass
class Level:
    """A Bloom filter: numpy bits and the number of hash functions."""

    bits: np.ndarray
    functions: int
    salt: int

    @classmethod
    def sized(cls, keys: int, rate: float, salt: int) -> Level:
        """For so many keys and this rate of false positives."""
        functions = max(1, round(-math.log2(rate)))
        n = max(64, math.ceil(keys * functions / math.log(2)))
        return cls(np.zeros(-(-n // 8), np.uint8), functions, salt)

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        size = _U(8 * len(self.bits))
        a, b = mix(hashes + _U(self.salt)), mix(hashes ^ _U(0x5851F42D4C957F2D + self.salt)) | _U(1)
        for i in range(self.functions):
            yield (a + _U(i) * b) % size

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate(list(self._places(hashes)))) if len(hashes) else np.zeros(0, _U)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self._places(hashes):
            out &= (self.bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1
        return out


class Cascade:
    """Levels in turn for listed keys and for the unlisted ones that pass all before."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def listed(self, hashes: np.ndarray) -> np.ndarray:
        passed = np.zeros(len(hashes), np.int64)
        open_ = np.ones(len(hashes), bool)
        for level in self.levels:
            open_[open_] = level.passes(hashes[open_])
            passed[open_] += 1
        return passed % 2 == 1

    @property
    def bytes(self) -> int:
        return sum(len(level.bits) for level in self.levels)


def _passing(shared: Broadcast) -> Callable[[Column], Column]:
    """Whether a hash passes the broadcast level."""

    def run(hashes: pa.Array) -> pa.Array:
        return pa.array(shared.value.passes(hashes.to_numpy(zero_copy_only=False).view(_U)))

    return arrow_udf(run, "boolean")


def _filled(keys: DataFrame, count: int, rate: float, salt: int) -> Level:
    """A level that holds the hashes of ``keys``; its words are joined by or before they are gathered."""
    level = Level.sized(max(1, count), rate, salt)
    size, functions = len(level.bits), level.functions

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Level(np.broadcast_to(np.uint8(0), size), functions, salt)
            at = own.places(batch.column(0).to_numpy(zero_copy_only=False).view(_U))
            bit = np.left_shift(_U(1), at & _U(63))
            word, begin = np.unique(at >> _U(6), return_index=True)
            bits = np.bitwise_or.reduceat(bit, begin) if len(begin) else bit
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"]
            )

    rows = keys.select("hash").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    got = rows.toArrow()  # at most SEGMENT_BITS / 64 words
    bits = np.zeros(-(-size // 8), "<u8")
    bits[got["word"].to_numpy()] = got["bits"].to_numpy().view(_U)
    level.bits = bits.view(np.uint8)[:size].copy()
    return level


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of the keys (host, path, hash) of ``listed`` over those of ``universe``.

    The first level's rate leaves about as many false positives as there are listed keys,
    whatever the size of the universe; each further level halves what is left.
    """
    spark = listed.sparkSession
    count = listed.count()
    if not count:
        return Cascade([])
    others = universe.agg(F.approx_count_distinct("hash")).first()[0]
    rate = min(0.5, max(1e-9, math.sqrt(0.5) * count / max(1, others)))
    levels = [_filled(listed, count, rate, 0)]

    def passing(keys: DataFrame) -> DataFrame:
        return keys.filter(_passing(spark.sparkContext.broadcast(levels[-1]))(F.col("hash")))

    rest = passing(universe).distinct().join(listed, ["host", "path"], "left_anti")
    inside, outside = listed, cut(rest, "unlisted")
    while count := outside.count():
        if len(levels) == MAX_LEVELS:
            raise ValueError("two keys share all hashes; the cascade cannot tell them apart")
        levels.append(_filled(outside, count, 0.5, len(levels)))
        inside, outside = outside, cut(passing(inside), "passing")
    return Cascade(levels)


def _flags(shared: Broadcast, segment: int, segments: int) -> Callable[[Column], Column]:
    def run(keys: pa.Array) -> pa.Array:
        sizes = np.array([0 if n is None else n for n in keys.value_lengths().to_pylist()], np.int64)
        hashes = keys.flatten().to_numpy(zero_copy_only=False).view(_U)
        own = np.flatnonzero((hashes >> _U(32)) % _U(segments) == _U(segment))
        out = np.zeros(len(hashes), bool)
        out[own] = shared.value.listed(hashes[own])
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))

    return arrow_udf(run, "array<boolean>")


def _segments(listed: DataFrame) -> int:
    """How many cascades a list needs, at the 44 bits a key that the lowest rate takes."""
    return max(1, -(-listed.count() * 44 // SEGMENT_BITS))


def judge_urls(
    urls: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = ALLOW
) -> DataFrame:
    """page_id, host, path, rule, verdict; one row per url.

    ``rules`` has the columns host, path and verdict (allow or block).
    """
    spark = urls.sparkSession
    known = only(rules, host="host", path="path", verdict="verdict").filter(
        "host is not null and path is not null and verdict in ('allow', 'block')"
    )
    known = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block is the greater
    known = cut(known.withColumn("hash", key_hash(F.struct("host", "path"))), "rules")
    shapes = shapes_of(known)
    rows = only(urls, page_id=page_id, url=url).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    rows = rows.withColumn("keys", keys_of(F.col("host"), F.col("path"), shapes))
    universe = rows.select(F.explode("keys").alias("key")).select("key.*", key_hash(F.col("key")).alias("hash"))
    rows = rows.withColumn("hashes", F.transform("keys", key_hash))
    for verdict in (BLOCK, ALLOW):
        listed = known.filter(F.col("verdict") == verdict).select("host", "path", "hash")
        segments = _segments(listed)
        flags = None
        for k in range(segments):
            own = F.pmod(F.shiftrightunsigned("hash", 32), F.lit(segments)) == k
            cascade = build_cascade(listed.filter(own), universe.filter(own))
            found = _flags(spark.sparkContext.broadcast(cascade), k, segments)(F.col("hashes"))
            if flags is None:
                flags = found
            else:
                flags = F.zip_with(F.col(verdict), found, lambda a, b: a | b)
            rows = rows.withColumn(verdict, flags)
            if segments > 1:  # so that no task holds two cascades
                rows = cut(rows, "judged")
    first = F.array_position(F.zip_with(BLOCK, ALLOW, lambda a, b: a | b), F.lit(True)).cast("int")
    judged = rows.withColumn("at", first)
    key = F.when(F.col("at") > 0, F.element_at("keys", F.col("at")))
    verdict = F.when(F.col("at") == 0, default).when(F.element_at(BLOCK, F.col("at")), BLOCK).otherwise(ALLOW)
    return judged.select(
        "page_id", "host", "path", F.concat(key["host"], key["path"]).alias("rule"), verdict.alias("verdict")
    )
