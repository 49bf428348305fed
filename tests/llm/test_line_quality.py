"""The chain against enumerated labellings, held-out accuracy, and edge cases."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from flowscope.llm import line_quality as lq
from flowscope.llm.queries import op11_quality_classifier

DATA = "/root/testdata/sf0.1"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(5)
    sizes = [1, 2, 3, 5, 1, 7]
    first = np.concatenate(([0], np.cumsum(sizes)))
    scores, turn = rng.normal(size=first[-1]) * 2, rng.normal(size=3)
    good, turns, added = lq.forward_backward(scores, first, turn)
    for a, b in zip(first[:-1], first[1:], strict=True):
        weights, total = {}, 0.0
        for states in itertools.product((0, 1), repeat=b - a):
            z = sum(scores[a + i] for i, s in enumerate(states) if s)
            for p, q in itertools.pairwise(states):
                z += turn[0] if p and q else turn[1] if q else turn[2] if p else 0.0
            weights[states] = np.exp(z)
            total += np.exp(z)
        assert added[a:b].sum() == pytest.approx(np.log(total))
        for i in range(b - a):
            assert good[a + i] == pytest.approx(sum(w for s, w in weights.items() if s[i]) / total)
            if i:
                for k, way in enumerate([(1, 1), (0, 1), (1, 0)]):
                    chance = sum(w for s, w in weights.items() if s[i - 1 : i + 1] == way) / total
                    assert turns[a + i, k] == pytest.approx(chance)


def test_measures_of_lines():
    texts = ["Ab cd\n\nAb cd", "", "x## x## x## é", "a" * 70_000 + "\n" + "b " * 50_000]
    lines, first = lq.measured_lines(texts)
    of = {name: lines[:, k] for k, name in enumerate(lq.MEASURES)}
    assert first.tolist() == [0, 3, 4, 5, 7]
    assert np.allclose(np.expm1(of["bytes"]), [5, 0, 5, 0, 14, 70_000, 100_000], rtol=1e-5)
    assert np.allclose(np.expm1(of["words"]), [2, 0, 2, 0, 4, 1, 50_000], rtol=1e-5)
    assert of["seen"].tolist() == [0, 0, 1, 0, 0, 0, 0]
    assert of["symbol_ends"][4] == pytest.approx(0.75) and of["echoes"][4] == pytest.approx(0.5)
    assert of["variety"][4] == pytest.approx(0.5) and of["upper"][0] == pytest.approx(0.2)
    alone = [lq.measured_lines([t])[0] for t in texts]  # a text's measures do not depend on its block
    assert np.allclose(np.concatenate(alone), lines)


GOOD = "Some plain words of a sentence {} that goes on.\nAnd another line with {} in it."
BAD = "###%% {} $$$ !!! ###\nBUY {} BUY BUY BUY BUY NOW!!!"


def rows_of(n):
    return [(i, (GOOD if i % 2 else BAD).format(i, i % 13)) for i in range(n)], [(i, i % 2) for i in range(n)]


def test_learns_and_scores_edge_cases(spark):
    docs, labels = rows_of(200)
    odd = [(900, None), (901, ""), (902, "\n\n\n"), (903, GOOD.format(1, 2) * 3000), (None, GOOD), (1, docs[1][1])]
    extra = [(0, 1), (None, 0), (5, None), (7, 4), (7777, 1)]  # 0 has both labels, 7777 no document
    table = spark.createDataFrame([(*r, 1.0, 2) for r in docs + odd], "doc_id long, text string, score double, quality int")
    known = spark.createDataFrame([(*r, "x") for r in labels + extra], "doc_id long, quality int, text string")
    model = lq.learn(table, known, per_label=60)
    got = [(r["doc_id"], r["score"]) for r in lq.line_quality(table, model).collect()]
    assert len(got) == len(docs) + len(odd)
    assert all(0 <= s <= 1 for _, s in got)
    by = dict(got)
    assert all((by[i] > 0.5) == (i % 2 == 1) for i in range(200))
    assert by[903] > 0.5 and by[900] == by[901]
    assert len({s for i, s in got if i == 1}) == 1


@pytest.mark.parametrize("labels", [[], [(1, 1), (3, 1)]])
def test_without_both_labels(spark, labels):
    docs, _ = rows_of(6)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    model = lq.learn(table, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert model is None and {r["score"] for r in lq.line_quality(table, model).collect()} == {0.5}
    assert lq.line_quality(table.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in op11_quality_classifier(spark, DATA).collect()}
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    known = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    held = [(rows[r["doc_id"]], r["quality"]) for r in known if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r["held_out"] for r, _ in held)
    good = [r["predicted"] for r, q in held if q == 1]
    bad = [r["predicted"] for r, q in held if q == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05
