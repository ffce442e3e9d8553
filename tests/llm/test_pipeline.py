"""The pipeline stage by stage, the queries' registration, and their SQL twins."""

from collections import Counter

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tests.compare import connect, differences
from tokenloom.llm.common import materialize
from tokenloom.llm.components import components

SF = "/root/testdata/sf0.001"


def test_registered():
    names = queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(n for n in oracle_sql() if n.startswith("op")))
def test_operator_query_equals_twin(llm, name):
    assert not differences(queries()[name](llm, SF), connect(SF), oracle_sql()[name])


def test_stages(llm, odd_docs):
    from pyspark.sql import functions as F

    given = llm.read.parquet(f"{SF}/documents.parquet")
    odd = odd_docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("doc_id", F.col("doc_id") + 10_000)
    docs = given.unionByName(odd.select(*given.columns))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(llm, docs, SF), f"test-{name}")
        kept[name] = docs
        if name != "encode":
            assert docs.columns == given.columns
    ids = {n: Counter(r["doc_id"] for r in d.select("doc_id").collect()) for n, d in kept.items()}
    lost = set(r["doc_id"] for r in given.select("doc_id").collect()) - set(ids["language"])
    assert not lost and not {10_002, 10_003, 10_004, 10_009} & set(ids["language"])
    assert ids["lines"] == ids["language"]
    assert set(ids["near_duplicates"]) <= set(ids["lines"]) and set(ids["mix"]) <= set(ids["near_duplicates"])
    assert max(ids["mix"].values()) <= 3 * max(ids["near_duplicates"].values()) and ids["encode"] == ids["mix"]
    texts = {r["doc_id"]: r for r in kept["lines"].collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values())


def test_each_text_is_judged_once(llm, odd_docs):
    """The first stage filters by what it finds; the filter must not bring a second Python worker to each task."""
    kept = corpus_pipeline.identify_language(llm, odd_docs.selectExpr("*", "length(text) as n_chars"), "")
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_run_equals_the_stages(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(llm, docs, SF), f"again-{name}")
    got = Counter(map(str, corpus_pipeline.run(llm, SF).collect()))
    assert got == Counter(map(str, docs.collect()))


def test_empty_documents(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(llm, docs, SF)
        assert docs.count() == 0


def test_components_of_a_chain_a_star_and_loops(llm):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (2000, 2001), (2001, 2000)]
    got = {r["id"]: r["component"] for r in components(llm.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)} | {2000: 2000, 2001: 2000}
    assert got == want
    assert components(llm.createDataFrame([], "a long, b long")).count() == 0
