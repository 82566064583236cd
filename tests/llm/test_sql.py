"""Queries that SQL can express, against it; the pipeline and the models by what they must and must not do."""

import os

import pytest

import corpus_pipeline
from tests.test_catalog import duck  # noqa: F401
from tracewright.llm import queries as Q

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    got = Q.QUERIES[name](spark, SF)
    want = duck.execute(Q.SQL[name])
    order = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(order)
    assert sorted(tuple(r) for r in got.select(*order).collect()) == sorted(want.fetchall())


def empty(spark, tmp_path):
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def test_empty_tables(spark, tmp_path):
    path = empty(spark, tmp_path)
    for name, query in Q.QUERIES.items():
        assert query(spark, path).count() == 0, name
    assert corpus_pipeline.run(spark, path).count() == 0


def test_leaks(spark):
    """A document that holds a whole item leaks it; one without any of its words does not."""
    from tracewright.llm.decontaminate import find_leaks

    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    item = bench.where("text is not null").orderBy("item_id").first()
    docs = spark.createDataFrame([(1, f"before {item.text} after"), (2, item.text), (3, "nothing of it here at all"), (4, None), (5, "")], "doc_id long, text string")
    assert {r.doc_id for r in find_leaks(docs, bench).where(f"item_id = {item.item_id}").collect()} == {1, 2}
    assert not find_leaks(docs, bench).where("doc_id > 2").count()


def test_pipeline_stages(spark):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, SF)
    assert kept.columns == docs.columns
    told = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    toxic, clean = [d for d, t in told.items() if t[1] == 1], [d for d, t in told.items() if t == (1, 0)]
    print("toxic kept", sum(d in ids for d in toxic), len(toxic), "clean kept", sum(d in ids for d in clean), len(clean))
    assert sum(d in ids for d in toxic) <= 0.1 * len(toxic) and sum(d in ids for d in clean) >= 0.9 * len(clean)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SMALL)
    rows = got.collect()
    assert set(got.columns) >= {"doc_id", "n_tokens", "ids", "decoded_sha256"} and rows
    assert all(len(r.ids) == 4 * r.n_tokens for r in rows)
