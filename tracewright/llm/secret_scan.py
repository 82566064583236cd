"""Secret scans over an incremental blob ledger (operator 9, DataFrame functions only).

Each version of a file is addressed by the SHA-256 of its content. The ledger is a written
table of the pairs of blob and rule version that were scanned, with what was found; a scan
takes one copy of each blob and only the rules that the ledger lacks for it, adds those pairs
to the ledger, and joins the findings, old and new, back to all paths that hold the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm._links import checkpointed, exists, hot_join, small, table_folder

#: Blobs that are broadcast at most, by their addresses; more of them are shuffled.
FEW_BLOBS = 50_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret: Java pattern; group whose length must be at least `least`; base rules are counted singly."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds in the order in which equal starts are listed. A run of
# [0-9a-f] or of AKIA[A-Z0-9] has no shorter match inside that could be long enough, so the
# least lengths stand in these patterns; in an assignment they can't, as a match that is too
# short still uses up its text.
BASE = (
    Rule("assign", 1, r"""((?:(?i)password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
LEDGER = "blob binary, rule string, spans array<struct<start:long,end:long>>"
NO_SPANS = "array<struct<start:bigint,end:bigint>>"


def content_of(content: Column) -> Column:
    return F.coalesce(content.cast("string"), F.lit(""))


def blob_of(content: Column) -> Column:
    """The address of a content: its SHA-256."""
    return F.unhex(F.sha2(content_of(content), 256))


def spans_in(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, spans) of each finding; blobs: blob, content and the names of the rules to be tried."""
    found = []
    for rule in rules:
        pattern = F.lit(rule.pattern)
        every = F.regexp_extract_all("content", pattern, F.lit(0))
        value = F.regexp_extract_all("content", pattern, F.lit(rule.group)) if rule.group else every
        gap = F.slice(F.split("content", rule.pattern, -1), F.lit(1), F.size(every))
        lengths = F.arrays_zip(*(F.transform(x, F.char_length).alias(n) for x, n in ((gap, "gap"), (every, "size"), (value, "value"))))
        found.append(F.when(F.array_contains("rules", rule.name) & F.col("content").rlike(rule.pattern), F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.least).alias("least"), lengths.alias("hits"))))
    hits = blobs.select("blob", F.explode(F.array_compact(F.array(*found))).alias("x")).select("blob", "x.rule", "x.least", F.posexplode("x.hits").alias("place", "hit"))
    hits = hits.select("blob", "rule", "least", "place", "hit.gap", "hit.size", "hit.value").distinct()
    end = F.expr("sum(gap + size) over (partition by blob, rule order by place)")
    spans = hits.withColumn("end", end.cast("long")).where("value >= least")
    return spans.groupBy("blob", "rule").agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("size")).alias("start"), "end"))).alias("spans"))


class BlobLedger:
    """Which blobs were scanned by which rule versions, and what was found, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def pairs(self) -> DataFrame:
        """(blob, rule, spans) of every scanned pair; no spans where nothing was found."""
        if not exists(self.spark, self.folder):
            return self.spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in (("blob", "binary"), ("rule", "string"), ("spans", NO_SPANS))))
        return self.spark.read.schema(LEDGER).parquet(self.folder)

    def unseen(self, versions: DataFrame, rules: tuple[Rule, ...], content: str = "text") -> DataFrame:
        """(blob, rules): each distinct blob of the versions with the rules that were not tried on it; blobs without any are left out."""
        names = F.array(*(F.lit(r.name) for r in rules))
        blobs = versions.select(blob_of(F.col(content)).alias("blob")).distinct()
        tried = self.pairs().where(F.col("rule").isin([r.name for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("tried"))
        left = blobs.join(tried, "blob", "left").select("blob", F.array_except(names, F.coalesce("tried", F.array().cast("array<string>"))).alias("rules"))
        return left.where(F.size("rules") > 0)

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...], content: str = "text") -> int:
        """Scans one copy of each unseen blob with its unseen rules and writes all those pairs down; returns how many blobs were read."""
        todo = checkpointed(self.unseen(versions, rules, content))
        count = todo.count()
        if count:
            copies = versions.select(blob_of(F.col(content)).alias("blob"), content_of(F.col(content)).alias("content"))
            copies = copies.join(small(todo, FEW_BLOBS).select("blob"), "blob", "left_semi") if count <= FEW_BLOBS else copies
            one = copies.groupBy("blob").agg(F.first("content").alias("content")).join(small(todo, FEW_BLOBS), "blob")
            found = spans_in(one, rules)
            pairs = todo.select("blob", F.explode("rules").alias("rule")).join(found, ["blob", "rule"], "left")
            pairs.select("blob", "rule", F.coalesce("spans", F.array().cast(NO_SPANS)).alias("spans")).write.mode("append").parquet(self.folder)
        return count


def secret_scan(docs: DataFrame, ledger: BlobLedger | None = None, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_<kind> of each base rule, base_spans and spans of each row.

    Spans are kind:start:end in code points, the end exclusive, by start and then in the order
    of the rules, joined by commas; base_spans has the base rules' alone. ledger: what was
    scanned before and is not scanned again; it takes up the new pairs (a new one is made
    where none is given). Null text is empty. Equal texts, repeated rows and null ids all get
    their own row. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    rules = (*base, *more)
    ledger = ledger or BlobLedger(docs.sparkSession, table_folder(docs.sparkSession, "blob-ledger"))
    ledger.scan(docs, rules, text_col)
    named = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.name), F.struct(F.lit(k).alias("rank"), F.lit(r.kind).alias("kind")))))
    known = ledger.pairs().where(F.col("rule").isin([r.name for r in rules]))
    flat = known.select("blob", named[F.col("rule")].alias("r"), F.explode_outer("spans").alias("s"))
    flat = flat.select("blob", F.when(F.col("s").isNotNull(), F.struct("s.start", "r.rank", "r.kind", "s.end")).alias("x"))
    each = flat.groupBy("blob").agg(F.sort_array(F.collect_list("x")).alias("x"))
    rows = checkpointed(docs.select(F.col(id_col).cast("long").alias("doc_id"), blob_of(F.col(text_col)).alias("blob")))
    got = hot_join(rows, each, "blob")

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def ranked(k: int) -> Column:
        return F.filter("x", lambda s: s["rank"] == k)

    counts = [F.size(ranked(k)).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(base)]
    return got.select("doc_id", *counts, text(F.filter("x", lambda s: s["rank"] < len(base))).alias("base_spans"), text(F.col("x")).alias("spans"))
