"""Written tables, bounded broadcasts, union by label and connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.storage import checkpointed, shared_folder


#: Rows in an Arrow batch at most: texts may be long, and a batch is held whole on both sides.
ARROW_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of ARROW_ROWS rows for this session, unless it asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def table_folder(spark: SparkSession, name: str) -> str:
    """A folder for a written table beside the checkpoints."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the groups of a and b; label is each place's least known place and stays flat."""
    while True:
        x, y = label[a], label[b]
        far = x != y
        if not far.any():
            return label
        a, b, x, y = a[far], b[far], x[far], y[far]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; edges: a, b long; root is the least node of the component.

    Alternates large stars and small stars (each node hands the least of its neighbours on to
    the larger ones, then to the smaller ones), which halves the distance to the root in each
    round. A node with many edges is never gathered: minima are pre-aggregated and joined back,
    and a join is split where it is skewed. The edges of each round are checkpointed.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = checkpointed(edges)
    state = None
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "k"), F.col("u") == F.col("k"))
        edges = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        edges = checkpointed(edges)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


#: A key with over a thousandth of the rows, and so many at least, is joined apart; there are a thousand of those at most.
HOT_SHARE, HOT_ROWS = 1000, 10_000


def hot_join(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """rows joined with one row a key; the rows of hot keys stay where they are, and the keys' own rows (a thousand at most) are broadcast."""
    hot = checkpointed(rows.groupBy(key).count().where(F.col("count") > max(HOT_ROWS, rows.count() // HOT_SHARE)).select(key))
    if hot.isEmpty():
        return rows.join(named, key)
    few = F.broadcast(named.join(F.broadcast(hot), key, "left_semi"))
    return rows.join(F.broadcast(hot), key, "left_anti").join(named, key).unionByName(rows.join(few, key))


#: Rows of two columns that are broadcast at most; with more of them a join is shuffled.
FEW_ROWS = 500_000


def small(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """df (computed already), to be broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= most else df


def shared_out(rows: DataFrame, key: list[str], member: Column, block: int) -> DataFrame:
    """Rows with columns `lo` and `hi`: a key of over `block` rows is cut in blocks, and each pair of blocks is a group of its own.

    Every two rows of one key meet in exactly one group (key, lo, hi) at least; a key of up to
    `block` rows makes one group. So no task holds much more than two blocks of one key.
    """
    hot = rows.groupBy(*key).count().where(F.col("count") > block).select(*(F.col(k).alias(f"_{k}") for k in key), F.ceil(F.col("count") / block).cast("long").alias("_n"))
    on = [F.col(k) == F.col(f"_{k}") for k in key]
    mine = F.pmod(member, F.coalesce("_n", F.lit(1).cast("long")))
    cut = rows.join(small(checkpointed(hot)), on, "left").withColumn("_i", mine).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_n", F.lit(1).cast("long")) - 1)))
    return cut.withColumn("lo", F.least("_i", "_j")).withColumn("hi", F.greatest("_i", "_j")).drop("_i", "_j", "_n", *(f"_{k}" for k in key))
