"""Line dedup over levelled sorted runs of line hashes (operator 5, DataFrame functions only).

Lines come in batches. A run is a table bucketed and sorted by line hash: how many documents
of its batches hold the line, and, if no earlier run has it, the document that keeps it. A
batch is reduced to one row a line and merge-anti-joined with all runs at once, bucket by bucket
and without an exchange of the runs, to find the lines that are new; these name their keeper, the
others only add to the count. The batch becomes a run of level 0; once a level has `fanout`
runs they are compacted into one of the next level. Merged, the runs give each line's number
of documents and its keeper. A manifest beside the runs lets a later session add to them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm._links import checkpointed, exists, hot_join, remove, table_folder

#: What is stripped from both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """A line's key: stripped, with A-Z lower-cased (lower() does that to a line of ASCII alone, and faster)."""
    bare = F.trim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


class LineRuns:
    """Levelled sorted runs of (h, n_docs, keeper) in a folder that the driver and all executors share.

    A folder that holds runs is opened again with their number of buckets, whatever is asked.
    """

    MANIFEST = "step long, run int, level int, live boolean, buckets int"

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 4, buckets: int | None = None):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, int] = {}  # run -> level, the runs in use
        self.tables: dict[int, str] = {}
        self.step = self.written = 0
        if exists(spark, f"{self.folder}/manifest"):
            rows = spark.read.schema(self.MANIFEST).parquet(f"{self.folder}/manifest").orderBy("step", "run").collect()
            for r in rows:
                self.step, self.written, self.buckets = max(self.step, r.step), max(self.written, r.run + 1), r.buckets
                if r.live:
                    self.levels[r.run] = r.level
                else:
                    self.levels.pop(r.run, None)

    def _table(self, run: int) -> DataFrame:
        """A run, by a name in the session's catalog that tells its buckets."""
        if run not in self.tables:
            name = f"line_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (h BINARY, n_docs BIGINT, keeper BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/run-{run}'")
            self.tables[run] = name
        return self.spark.table(self.tables[run])

    def runs(self) -> list[DataFrame]:
        return [self._table(run) for run in sorted(self.levels)]

    @contextmanager
    def _seen(self) -> Iterator[DataFrame]:
        """(h) of every line of the runs, once each: one run alone names a line's keeper.

        The runs are partitions of one table, so a task reads a bucket of all of them and nothing is exchanged.
        """
        name = f"line_runs_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (h BINARY, n_docs BIGINT, keeper BIGINT, run INT) USING parquet PARTITIONED BY (run) CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'")
        try:
            parts = " ".join(f"PARTITION (run = {run}) LOCATION '{self.folder}/run-{run}'" for run in sorted(self.levels))
            self.spark.sql(f"ALTER TABLE {name} ADD {parts}")
            yield self.spark.table(name).where("keeper IS NOT NULL").select("h")
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _write(self, rows: DataFrame, level: int, instead_of: list[int]) -> None:
        """Writes a run; the manifest takes it up, and drops those that it replaces, in one step."""
        run, name = self.written, f"line_run_{uuid.uuid4().hex}"
        self.written += 1
        rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.folder}/run-{run}").format("parquet").saveAsTable(name)
        self.tables[run] = name
        self.step += 1
        told = [(self.step, run, level, True, self.buckets), *((self.step, old, self.levels[old], False, self.buckets) for old in instead_of)]
        rows = ", ".join(f"({a}L, {b}, {c}, {str(d).lower()}, {e})" for a, b, c, d, e in told)
        self.spark.sql(f"SELECT * FROM VALUES {rows} AS t(step, run, level, live, buckets)").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        self.levels[run] = level
        for old in instead_of:
            del self.levels[old]
            if old in self.tables:  # an opened folder's runs have names only where runs() was asked
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(old)}")
            remove(self.spark, f"{self.folder}/run-{old}")

    def _merged(self, runs: list[int]) -> DataFrame:
        # read as plain files: a union of bucketed tables still claims their buckets, but has lost them
        both = self.spark.read.schema("h binary, n_docs long, keeper long").parquet(*(f"{self.folder}/run-{run}" for run in runs))
        return both.groupBy("h").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def add(self, lines: DataFrame) -> None:
        """Adds a batch of distinct (h, doc) of documents that no batch had before.

        A line that is new to the runs is kept by the document of this batch with the largest
        doc; so documents with larger ids go first where the largest of all is to keep a line.
        """
        batch = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("keeper"))
        if self.levels:
            with self._seen() as seen:
                # a left merge join that marks the lines the runs have, one row a line: what they lack is the anti-join
                marked = batch.join(seen.withColumn("_seen", F.lit(True)), "h", "left")
                self._write(marked.select("h", "n_docs", F.when(F.col("_seen").isNull(), F.col("keeper")).alias("keeper")), 0, [])
        else:
            self._write(batch, 0, [])
        level = 0
        while len(same := [run for run, at in self.levels.items() if at == level]) >= self.fanout:
            self._write(self._merged(same), level + 1, same)
            level += 1

    def counts(self) -> DataFrame:
        """(h, n_docs, keeper) of every line."""
        if not self.levels:
            return self.spark.sql("SELECT X'' AS h, 0L AS n_docs, 0L AS keeper").limit(0)
        return self._merged(sorted(self.levels))

    def close(self, delete: bool = False) -> None:
        """Takes the runs' names out of the session's catalog; delete: the folder, too."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = {}
        if delete:
            remove(self.spark, self.folder)


#: Lines in the first batches, about; each further batch doubles what came before.
BATCH_LINES = 250_000


def batches_for(lines: int) -> int:
    """How many batches a table of so many lines makes: one more whenever it doubles."""
    return max(2, (lines // BATCH_LINES).bit_length() + 1)


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int | None = None, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without the lines that many documents hold.

    Adds n_lines, n_dropped and kept_text (the other lines, joined by \\n) to the columns of
    docs; columns of those names are replaced. A line whose key has at least `min_chars` code
    points and is found in at least `min_docs` documents goes, save in the document with the
    largest id. Null text is one empty line (1, 0, ''). Rows with one id count as one
    document, and all of them keep its lines; null ids count as one document, smaller than
    all. Each row comes out once. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    # which lines of which text, by hashes only
    keys = docs.select(doc.alias("doc"), F.unhex(F.md5(text)).alias("body"), F.posexplode(F.split(text, "\n", -1)).alias("place", "line"))
    keys = keys.where(F.char_length(F.trim("line", F.lit(BLANK))) >= min_chars)
    keys = checkpointed(keys.select("doc", "body", "place", F.unhex(F.md5(line_key(F.col("line")))).alias("h")))
    batches = batches or batches_for(keys.count())
    # the largest ids go first; each further batch is as large as all before it, so what a batch reads of the runs grows with it
    parts = [1 - 0.5**k for k in range(1, batches)]
    cuts = keys.select("doc").distinct().select(F.percentile_approx("doc", parts, 10_000)).first()[0] or [] if batches > 1 else []
    runs = LineRuns(spark, table_folder(spark, "line-runs"), fanout)
    edges = [None, *sorted(set(cuts)), None]
    for low, high in list(zip(edges, edges[1:], strict=False))[::-1]:
        some = keys
        if low is not None:
            some = some.where(F.col("doc") > low)
        if high is not None:
            some = some.where(F.col("doc") <= high)
        runs.add(some.select("h", "doc").distinct())
    many = checkpointed(runs.counts().where(F.col("n_docs") >= min_docs).select("h", "keeper"))
    runs.close(delete=True)
    gone = hot_join(keys, many, "h").where("doc <> keeper").select("doc", "body", "place").distinct()
    drops = gone.groupBy("doc", "body").agg(F.sort_array(F.collect_list("place")).alias("_drop")).select(F.col("doc").alias("_doc"), F.col("body").alias("_body"), "_drop")
    whole = docs.drop("n_lines", "n_dropped", "kept_text")
    row = F.struct(*(whole[f"`{c}`"] for c in whole.columns)).alias("_row")
    joined = whole.select(row, doc.alias("_id"), F.unhex(F.md5(text)).alias("_b")).join(drops, (F.col("_id") == F.col("_doc")) & (F.col("_b") == F.col("_body")), "left")
    again = F.coalesce(F.col("_row")[text_col].cast("string"), F.lit(""))
    out = joined.select("_row", again.alias("_text"), F.split(again, "\n", -1).alias("_lines"), F.coalesce("_drop", F.array().cast("array<int>")).alias("_d"))
    out = out.withColumn("_ends", F.concat(F.array(F.lit(-1)), F.col("_d"), F.array(F.size("_lines"))))
    # between two dropped places the lines stay: one slice a gap, so the work is linear
    gaps = F.transform(F.sequence(F.lit(1), F.size("_ends") - 1), lambda k: F.slice("_lines", F.element_at("_ends", k) + 2, F.element_at("_ends", k + 1) - F.element_at("_ends", k) - 1))
    kept = F.when(F.size("_d") == 0, F.col("_text")).otherwise(F.array_join(F.flatten(gaps), "\n"))
    return out.select("_row.*", F.size("_lines").cast("long").alias("n_lines"), F.size("_d").cast("long").alias("n_dropped"), kept.alias("kept_text"))
