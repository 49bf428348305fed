"""The registered queries over a whole small data set, and the pipeline."""

from __future__ import annotations

import zlib

import corpus_pipeline
import duckdb
import pytest
from flowscope.llm.queries import ORACLE, QUERIES

from .test_parity_join import brute

DATA = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    result = duck.execute(ORACLE[name])
    header = [d[0] for d in result.description]
    assert sorted(header) == sorted(df.columns)
    theirs = sorted(map(repr, result.fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select(*header).collect()) == theirs


def test_similar_documents_equal_brute_force(spark, duck):
    rows = duck.execute("select doc_id, text from documents").fetchall()
    # The brute force splits at spaces and line ends only, which is all that these texts have.
    assert {tuple(r) for r in QUERIES["op4_ngram_join"](spark, DATA).collect()} == brute(rows)


@pytest.mark.parametrize("name, held", [("op3_toxicity", (3, 1)), ("op8_language_id", (4, 2))])
def test_held_out_rows_are_marked(spark, name, held):
    parts, remainder = held
    rows = QUERIES[name](spark, DATA).collect()
    assert len(rows) == 200
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == remainder)
        assert 0 <= r["score"] <= 1


def test_pipeline(spark, duck):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    kept, columns = {r["doc_id"] for r in docs.collect()}, docs.columns
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns
        ids = [r["doc_id"] for r in docs.collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= kept
        kept = set(ids)
        sizes.append(len(ids))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    packed = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in packed.collect()} == kept
    for name, value in (("quality", "op9_quality_rules"),):
        good = {r["doc_id"] for r in QUERIES[value](spark, DATA).collect() if r["kept"]}
        assert kept <= good, name
