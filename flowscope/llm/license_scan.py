"""License scan by MinHash bands over overlapping text windows.

Templates fall into classes by their length in words; for each class texts are cut into
windows of three halves of that length, every half of it, so that a notice as long as a
template lies in some window.  Windows and templates meet when they agree in one of so many
MinHash bands that a match is missed with a chance below ``MISS``; what meets is verified by
the exact share of the template's shingles that the window has.  Everything is built-in
column functions.

Defined results: a null or empty text, or one with fewer words than a shingle, matches
nothing; so does such a template.  Repeated rows count once.  A template of which a text has
nothing but what it has of another found one does not count (versions of a header, a text
within another); of those with the very same shingles found the highest containment counts,
all of them when equal.  Of several windows with the same containment the first is reported.
Empty tables give an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowscope.llm.license_texts import HEADERS, WHOLE
from flowscope.llm.tables import cut, only

SHINGLE = 3
CONTAINMENT = 0.75
MISS = 1e-4
# Up to so many template shingles, texts without any of them are left out beforehand: they
# cannot reach a containment above zero.  Larger template sets go without this.
LITERAL_SHINGLES = 5_000

# Customary notices by which texts name their license; fixed values, as text.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This work is subject to the terms of the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
]


def notices(spark: SparkSession) -> DataFrame:
    rows = [(i, name, text) for i, (name, text) in enumerate(NOTICES)]
    return spark.createDataFrame(rows, "template_id long, license string, text string")


def license_templates(spark: SparkSession) -> DataFrame:
    """The notices, and after them the whole texts and standard headers."""
    rows = [(i, name, text) for i, (name, text) in enumerate(WHOLE + HEADERS, len(NOTICES))]
    return notices(spark).union(spark.createDataFrame(rows, "template_id long, license string, text string"))


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; an empty array for none."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def shingles_of(words: Column) -> Column:
    """A hash for every run of ``SHINGLE`` words, in order; ``words`` must be a plain column.

    An expression in its place would be worked out anew for every word.
    """
    last = F.size(words) - SHINGLE
    run = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), run)).otherwise(F.array().cast("array<bigint>"))


def class_of(words: int) -> int:
    """The smallest power of two that is not below ``words``, 8 at least."""
    return max(8, 1 << (words - 1).bit_length())


def bands_for(size: int, shingles: list[int]) -> int:
    """Bands of one row each that meet with a chance of 1 - MISS at the lowest possible similarity.

    ``shingles`` are the numbers of shingles that templates of the class have.  A template
    contained to ``CONTAINMENT`` in a window of three halves has at least the Jaccard
    similarity with it that it has with a full window.
    """
    window = 3 * size // 2 - SHINGLE + 1
    common = [(n, math.ceil(CONTAINMENT * n)) for n in shingles]
    return math.ceil(math.log(MISS) / math.log(1 - min(c / (window + n - c) for n, c in common)))


def minhashes(shingles: Column, bands: int) -> Column:
    """The smallest value of each band's hash function over the shingles."""

    def least(band: int) -> Column:
        return F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(band))))

    return F.array(*[least(b) for b in range(bands)])


def windows_of(shingles: Column, size: int) -> Column:
    """(start, shingles) of every window of a class; the last ones are shorter."""
    stride, length = size // 2, 3 * size // 2 - SHINGLE + 1
    starts = F.sequence(F.lit(0), F.greatest(F.size(shingles) - 1, F.lit(0)), F.lit(stride))
    cut_out = lambda s: F.struct(s.alias("start"), F.array_distinct(F.slice(shingles, s + 1, length)).alias("own"))
    return F.transform(starts, cut_out)


def _distinct_shingles(templates: DataFrame) -> list[int]:
    """The templates' shingles, one more than ``LITERAL_SHINGLES`` at most."""
    return [r["s"] for r in templates.select(F.explode("theirs").alias("s")).distinct().limit(LITERAL_SHINGLES + 1).collect()]


def _literal(shingles: list[int]) -> Column:
    return F.array(*[F.lit(s) for s in shingles]).cast("array<bigint>")


def license_matches(
    docs: DataFrame, templates: DataFrame, doc_id: str = "doc_id", text: str = "text", containment: float = CONTAINMENT
) -> DataFrame:
    """doc_id, template_id, license, containment, word_from; the best window of each document and template.

    ``templates`` has template_id, license and text.
    """
    if containment < CONTAINMENT:
        raise ValueError(f"the bands are set for containments of {CONTAINMENT} at least")
    known = only(templates, template_id="template_id", license="license", text="text")
    known = known.withColumn("words", words_of(F.col("text"))).withColumn(
        "theirs", F.array_distinct(shingles_of(F.col("words")))
    )
    known = cut(known.filter(F.size("theirs") > 0).withColumn("n_words", F.size("words")).drop("words", "text"), "templates")
    source = only(docs, doc_id=doc_id, text=text).withColumn("row", F.xxhash64("doc_id", "text"))
    worded = source.select("doc_id", "row", words_of(F.col("text")).alias("words"))
    # Exploding a single element keeps later filters from being pushed below the hashing, where
    # the words would be split anew for every shingle.
    rows = worded.select("doc_id", "row", F.explode(F.array(shingles_of(F.col("words")))).alias("shingles"))
    every = _distinct_shingles(known)
    if len(every) <= LITERAL_SHINGLES:
        rows = rows.filter(F.arrays_overlap("shingles", _literal(every)))
    rows = cut(rows.filter(F.size("shingles") > 0), "scanned")
    sizes = sorted({class_of(r["n_words"]) for r in known.select("n_words").distinct().collect()})
    found = None
    for size in sizes:
        low = size // 2 if size > 8 else 0
        own = known.filter((F.col("n_words") > low) & (F.col("n_words") <= size))
        lengths = [r["n"] for r in own.select(F.size("theirs").alias("n")).distinct().collect()]
        bands = bands_for(size, lengths)
        scanned, likely = rows, F.lit(True)
        if len(every) <= LITERAL_SHINGLES:
            # Texts and windows with less of the class than its smallest template needs cannot match.
            need = math.ceil(containment * min(lengths))
            likely = F.size(F.array_intersect(F.col("own"), _literal(_distinct_shingles(own)))) >= need
            scanned = rows.withColumn("own", F.col("shingles")).filter(likely).drop("own")
        windows = scanned.select("doc_id", "row", F.explode(windows_of(F.col("shingles"), size)).alias("w")).select(
            "doc_id", "row", "w.start", "w.own"
        ).filter(likely)
        banded = windows.select("*", F.posexplode(minhashes(F.col("own"), bands)).alias("band", "value"))
        of_template = own.select("*", F.posexplode(minhashes(F.col("theirs"), bands)).alias("band", "value"))
        met = banded.join(of_template, ["band", "value"])
        verified = met.withColumn("common", F.array_intersect("own", "theirs"))
        verified = verified.withColumn("containment", F.size("common") / F.size("theirs"))
        verified = verified.filter(F.col("containment") >= containment)
        part = verified.select("doc_id", "row", "template_id", "license", "containment", "start", "common")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("doc_id", F.lit(None).cast("long").alias("template_id"), F.lit(None).cast("string").alias("license"),
            F.lit(None).cast("double").alias("containment"), F.lit(None).cast("int").alias("word_from")).limit(0)
    best = F.max(F.struct(F.col("containment").alias("c"), (-F.col("start")).alias("s"), "common")).alias("best")
    merged = found.groupBy("doc_id", "row", "template_id", "license").agg(best)
    # As many as there are templates at most; what a text has of each of them.
    of_text = F.collect_list(F.struct("best.c", "best.common")).over(Window.partitionBy("row"))
    common, n_common = F.col("best.common"), F.size("best.common")
    outdone = F.exists(
        "of_text",
        lambda o: (F.size(F.array_except(common, o["common"])) == 0)
        & ((F.size(o["common"]) > n_common) | (o["c"] > F.col("best.c"))),
    )
    return merged.withColumn("of_text", of_text).filter(~outdone).select(
        "doc_id", "template_id", "license", F.col("best.c").alias("containment"), (-F.col("best.s")).alias("word_from")
    )
