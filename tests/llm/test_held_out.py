"""The classifier on rated documents that it was not fitted on; copies of them may be among those it was fitted on."""

from tracewright.llm.quality import quality_filter
from tracewright.llm.queries import graded


def test_held_out(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    chosen = {r[0] for r in quality_filter(docs, graded(labels.where("doc_id % 4 < 2"))).select("doc_id").collect()}
    held = labels.where("doc_id % 4 >= 2").collect()
    toxic = [r.doc_id in chosen for r in held if r.toxic == 1]
    good = [r.doc_id in chosen for r in held if r.toxic == 0 and r.quality == 1]
    assert sum(toxic) <= 0.1 * len(toxic) and sum(good) >= 0.9 * len(good)
