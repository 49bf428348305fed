"""Importance resampling against a plain loop, and its edge cases."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest
from flowscope.llm.resampling import grams_of, resampled

SHAPE = "doc_id long, text string"


def features(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)], len(words)


def brute(docs, target, min_words, share_pct, buckets=10_000):
    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            counts.update(crc32(f.encode()) % buckets for f in features(text)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {
        b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
        for b in range(buckets)
    }
    out = []
    for doc_id, text in docs:
        found, n_words = features(text)
        weight = sum(gain[crc32(f.encode()) % buckets] for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, n_words, len(found), weight, score))
    long_enough = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(long_enough[: share_pct * len(long_enough) // 100], 1):
        ranks.setdefault(r, []).append(k)
    return sorted(((*r, ranks[r].pop(0) if ranks.get(r) else None) for r in out), key=repr)


def ours(spark, docs, target, **options):
    df = resampled(spark.createDataFrame(docs, SHAPE), spark.createDataFrame([(x,) for x in target], "text string"), **options)
    return sorted(map(tuple, df.collect()), key=repr)


DOCS = [
    (1, "Alpha beta gamma ALPHA beta"),
    (2, None),
    (3, ""),
    (4, "... \x00 --"),
    (5, "Éa é1 naïve x" * 30),
    (6, "alpha beta gamma alpha beta"),
    (6, "alpha beta gamma alpha beta"),
    (None, "one two three four"),
    (7, "word " * 3000),
    *[(100 + i, f"alpha w{i % 7} beta w{i % 3} tail") for i in range(60)],
]
TARGET = ["alpha beta gamma", None, "tail alpha w1"]


@pytest.mark.parametrize("share_pct, min_words", [(0, 0), (5, 2), (50, 4), (100, 0)])
def test_equals_brute_force(spark, share_pct, min_words):
    options = {"share_pct": share_pct, "min_words": min_words}
    assert ours(spark, DOCS, TARGET, **options) == brute(DOCS, TARGET, min_words, share_pct)


def test_empty_tables(spark):
    assert ours(spark, [], TARGET) == []
    assert ours(spark, DOCS, [], share_pct=10, min_words=1) == brute(DOCS, [], 1, 10)


def test_other_columns_are_left_alone(spark):
    docs = spark.createDataFrame([(1, "a b c", 9, 9, 9)], "doc_id long, text string, row long, range int, score long")
    target = spark.createDataFrame([("a b", 1)], "text string, bucket int")
    assert len(resampled(docs, target, min_words=1, share_pct=100).collect()) == 1


@pytest.mark.parametrize("piece", [1, 7, 50])
def test_pieces_change_nothing(piece):
    texts = [x or "" for _, x in DOCS]
    whole, cut = grams_of(texts, 10_000), grams_of(texts, 10_000, piece)
    for k in range(3):
        pairs = [Counter(zip(g.texts[k].tolist(), g.buckets[k][g.ids[k]].tolist(), strict=True)) for g in (whole, cut)]
        assert pairs[0] == pairs[1]
