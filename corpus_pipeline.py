"""A training-data pipeline over `documents`; counted as part of the subpackage tracewright.llm.

Each stage takes (spark, docs, sf_dir) and calls one operator on all that its predecessor
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import near_duplicates as near
from tracewright.llm._links import remove, table_folder
from tracewright.llm.bpe import bpe_encode
from tracewright.llm.decontaminate import decontaminate
from tracewright.llm.line_dedup import line_dedup
from tracewright.llm.quality import quality_filter
from tracewright.llm.queries import graded, vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the documents that the classifier, fitted on this input's rated documents, selects.

    Null texts count as empty, rows with null or repeated ids are judged each; without ratings of two grades all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_filter(docs, graded(labels)).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines that three documents or more hold stay in the one with the largest id; n_chars follows.

    Null texts stay null. Rows of one id are one document, null ids are one, smaller than all; every row stays.
    """
    names = {c: f"_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    got = line_dedup(docs.withColumnsRenamed(names))
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    new = {"text": text, "n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)}
    return got.select(*(new.get(c, F.col(names.get(c, c))).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near-duplicates one document stays, the one with the smallest id.

    Groups are texts linked by a similarity of 0.8 or more on five-word shingles; texts without words
    are one. Of equal rows one stays; rows without an id stay all.
    """
    return near.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: rows whose text holds an item of the benchmark go; null and empty texts stay, whatever their ids."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: doc_id, n_tokens, ids (packed) and the hash of the decoded text, one row for each row; null is empty."""
    got = bpe_encode(docs, vocabulary()).withColumn("decoded_sha256", F.sha2("decoded", 256))
    return got.select("doc_id", "n_tokens", "ids", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding and decoding", encode),
]

#: SQL has no classifier, XXH64 or BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's result is written as Parquet beside the checkpoints and read again.

    A stage's table is deleted once its successor's is written; the last stage reads the last table.
    Null texts and ids, repeated rows and empty tables go through every stage as its operator says.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = table_folder(spark, f"pipeline-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if last is not None:
                remove(spark, last)
            last = path
    return docs
