"""The value of each subformula at each position, for debugging."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import relation as R
from tracewright.plans.compiler import negated
from tracewright.plans.formula import children, show
from tracewright.plans.monitor import Monitor
from tracewright.sources.trace import Trace

TREE = "pos long, node int, depth int, formula string, value string"


def _nested(f, depth: int = 0) -> Iterator[tuple]:
    yield f, depth
    for part in children(f):
        yield from _nested(part, depth + 1)


def tree_rows(monitor: Monitor, name: str, trace: Trace) -> DataFrame:
    """pos, node, depth, formula, value: one row a position, subformula and binding of its free variables.

    node numbers the subformulas from the root down. value is true or false where no binding is
    told apart; else x=a,y=b for a binding that satisfies the subformula, or not(x=a,y=b) for one
    of finitely many that don't. Constraints on data, and conjunctions within conjunctions, have
    no rows of their own.
    """
    if monitor.timed:
        trace.axis.timed()
    compiler, root = monitor.compiler(name, trace), monitor.formulas[name]
    compiler.evaluate(root, {})
    originals = monitor.names[name]
    out = trace.spark.createDataFrame([], TREE)
    for node, (f, depth) in enumerate(_nested(root)):
        if id(f) not in compiler.nodes:
            continue
        value = compiler.nodes[id(f)][1]
        rel, usual = compiler.finite(value, {}), "false"
        if rel is None:
            rel, usual = compiler.finite(negated(value), {}), "true"
        if rel is None:
            continue
        points = R.spread_points(rel if rel.points else R.runs(rel, trace.axis)).df
        pairs = [F.concat(F.lit(f"{originals.get(v, v)}="), F.col(R.col(v)).cast("string")) for v in rel.vars]
        told = F.array_join(F.array(*pairs), ",") if pairs else F.lit("true")
        told = F.concat(F.lit("not("), told, F.lit(")")) if usual == "true" else told
        each = points.select(F.col("f").alias("_at"), told.alias("_told")).distinct()
        rows = trace.positions.select("pos").join(each, F.col("pos") == F.col("_at"), "left")
        out = out.unionByName(rows.select("pos", F.lit(node).alias("node"), F.lit(depth).alias("depth"), F.lit(show(f)).alias("formula"), F.coalesce("_told", F.lit(usual)).alias("value")))
    return out
