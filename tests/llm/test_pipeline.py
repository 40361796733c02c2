"""The pipeline's stages, and the queries of the subpackage against their SQL."""

import os

import pytest

import corpus_pipeline
from llm.conftest import COLUMNS, multiset, pieces, words
from oracle_check import compare, connect
from rowscrub.llm.queries import OPERATORS, ORACLES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), name, FOLDER) is None


def test_thirteen_operators():
    assert sorted(int(f.__name__[2:].split("_")[0]) for f in OPERATORS) == list(range(1, 14))


@pytest.fixture(scope="module")
def folder(spark, documents, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    documents.write.parquet(f"{path}/documents.parquet")
    source = words(max((t or "" for t in texts), key=len))
    items = [(1, " ".join(source[50:75])), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_keep_columns_and_take_effect(spark, folder, texts):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    benchmark = words(spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first()["text"])
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.schema.simpleString() == docs.schema.simpleString()
        path = f"{folder}/{name}"
        after.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert set(seen["language"]) == {i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    assert len(seen["near_dedup"]) < len(seen["language"])
    final = seen["decontaminate"]
    assert final != seen["substring_dedup"] != seen["near_dedup"]
    for text in final.values():
        w = words(text)
        assert all(w[k : k + 10] != benchmark[j : j + 10] for k in range(len(w)) for j in range(len(benchmark) - 9))
    whole = {}
    for i, text in sorted(seen["substring_dedup"].items()):
        for k in range(len(pieces(text)) - 12):
            assert whole.setdefault(tuple(pieces(text)[k : k + 13]), i) == i
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.collect()} == set(final)
    assert multiset(corpus_pipeline.run(spark, folder).drop("sequence_id", "offset")) == multiset(packed.drop("sequence_id", "offset"))


def test_odd_and_empty_tables(spark, folder, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
            docs.count()
    assert empty.schema.simpleString() == spark.createDataFrame([], COLUMNS).schema.simpleString()


def test_near_dedup_by_row(spark):
    """Rows without an id and rows that share one: copies among them go, different texts stay."""
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"x{i}" for i in range(60))
    third = " ".join(f"y{i}" for i in range(60))
    rows = [(None, text), (None, text), (5, text + " and"), (7, text), (5, other), (None, other), (None, third), (None, third), (9, None), (9, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(repr, ((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())))
    assert got == sorted(map(repr, [(5, text + " and"), (5, other), (None, third), (9, None), (None, None)]))
