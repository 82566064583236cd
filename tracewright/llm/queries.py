"""One query an operator over its whole table, with production parameters, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.bpe import bpe_encode
from tracewright.llm.decontaminate import find_leaks
from tracewright.llm.line_dedup import line_dedup
from tracewright.llm.quality import quality_filter
from tracewright.llm.secret_scan import secret_scan
from tracewright.llm.simhash import simhash_components
from tracewright.llm.substring_dedup import substring_dedup
from tracewright.llm.suffix_dedup import suffix_dedup
from tracewright.llm.topk_search import top_k
from tracewright.llm.url_filter import junk_page, listed_host, rule, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup(_table(spark, sf_dir, "documents"), window=35)
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


URL_RULES = (rule("block", "com/en/"), rule("allow", "example.com/en/7"), rule("allow", "net/de/"), rule("block", "example.net/de/8"), rule("block", "org/es/"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models learn from pages that are junk by their content or of a listed host, against all others."""
    return url_filter(_table(spark, sf_dir, "pages"), URL_RULES, junk_page(F.col("html")) | listed_host(F.col("url")))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash_components(_table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks: one row a document and benchmark item."""
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup(_table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The text of a public tokenizer's file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe_encode(_table(spark, sf_dir, "documents"), vocabulary())
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup(_table(spark, sf_dir, "documents"), length=50)
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secret_scan(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def graded(labels: DataFrame) -> DataFrame:
    """Ratings of 0, 1 and 2: a point for good quality, a point for no toxicity."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier selects."""
    got = quality_filter(_table(spark, sf_dir, "documents"), graded(_table(spark, sf_dir, "labels")))
    return got.select("doc_id", "expected_grade", "p_level")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_line_dedup": op5_line_dedup,
    "op6_bpe": op6_bpe,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_topk_search": op8_topk_search,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_classifier": op10_quality_classifier,
}

_OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d),
windows AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS s FROM starts),
again AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS n FROM windows SEMI JOIN again USING (s)),
words AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS n, unnest(w) AS word FROM d),
met AS (SELECT words.doc_id, words.n, word, gone.n IS NOT NULL AS out FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.n = gone.n),
each AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (out) AS n_removed, string_agg(word, ' ' ORDER BY n) FILTER (NOT out) AS kept FROM met GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN each ON d.doc_id = each.doc_id"""

_OP5 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key AS held, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
met AS (SELECT k.*, held IS NOT NULL AND doc_id <> keeper AS out FROM k LEFT JOIN common ON key = held)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (out) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT out), '')) AS kept_sha256
FROM met GROUP BY doc_id"""

_OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

#: XXH64 (op3), BPE (op6), bytes of UTF-8 (op7), places of matches (op9) and the models have no SQL: they are tested against brute force.
SQL: dict[str, str] = {"op1_substring_dedup": _OP1, "op5_line_dedup": _OP5, "op8_topk_search": _OP8}
