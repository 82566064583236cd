"""Command line: python -m tracewright SPEC LOG [trace] [debug].

Prints violations (or, with `trace`, each position's verdicts; with `debug`, the value of each
subformula at each position) and the values that parameters may have. The exit code is 1 if a
property is violated, 0 if none is, 2 if the command can't be understood.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.plans.monitor import Monitor
from tracewright.plans.parametric import constraints, region
from tracewright.plans.tree import tree_rows
from tracewright.sources.trace import Trace, read_log

USAGE = "usage: python -m tracewright SPEC LOG [trace] [debug]"
FLAGS = ("trace", "debug")


# The words of the lines about violations, verdicts and totals below, which readers of such logs look for.


def fact_texts(trace: Trace, timed: bool) -> DataFrame:
    """_at, fact: the facts of each position as text, with its time if there is one."""
    each = trace.facts.select("pos", F.concat("pred", F.when(F.size("args") > 0, F.concat(F.lit("("), F.array_join("args", ","), F.lit(")"))).otherwise("")).alias("fact"))
    joined = each.groupBy("pos").agg(F.array_join(F.sort_array(F.collect_list("fact")), " ").alias("fact"))
    got = trace.positions.select(F.col("pos").alias("_at"), F.col("ts").alias("_ts")).join(joined, F.col("_at") == F.col("pos"), "left")
    text = F.coalesce("fact", F.lit(""))
    return got.select("_at", (F.concat(text, F.lit(" @ "), F.col("_ts").cast("string")) if timed else text).alias("fact"))


def condition(kind: str, bound: int | None, name: str) -> str:
    """A parametric verdict as text."""
    return {"true": "true", "false": "false", "ge": f"{bound} <= {name}", "le": f"{name} <= {bound}"}[kind]


def verdict_texts(monitor: Monitor, name: str, trace: Trace) -> DataFrame:
    """_pos and the verdict of each judged position as text."""
    if not monitor.params[name]:
        return monitor.verdicts(name, trace).select(F.col("pos").alias("_pos"), F.when(F.col("holds"), "holds").otherwise("VIOLATED").alias(name))
    told = None
    for param, _ in monitor.params[name]:
        bound = F.col("bound").cast("string")
        text = F.when(F.col("kind") == "ge", F.concat(bound, F.lit(f" <= {param}"))).when(F.col("kind") == "le", F.concat(F.lit(f"{param} <= "), bound))
        mine = constraints(monitor, name, trace, param).select(F.col("pos").alias("_pos"), (F.col("kind") == "false").alias("_never"), text.alias(f"_{param}"))
        told = mine if told is None else told.join(mine.drop("_never"), "_pos")
    asked = F.concat_ws(" & ", *(F.col(f"_{p}") for p, _ in monitor.params[name]))
    return told.select("_pos", F.when(F.col("_never"), "VIOLATED").when(asked == "", "holds").otherwise(F.concat(F.lit("holds iff "), asked)).alias(name))


def trace_table(monitor: Monitor, trace: Trace) -> DataFrame:
    """pos, fact and one column a property: holds, VIOLATED, holds iff a condition, or - where it isn't judged."""
    out = trace.positions.select("pos").join(fact_texts(trace, monitor.timed), F.col("pos") == F.col("_at")).drop("_at")
    for name in monitor.spec.properties:
        out = out.join(verdict_texts(monitor, name, trace), F.col("pos") == F.col("_pos"), "left").drop("_pos").withColumn(name, F.coalesce(name, F.lit("-")))
    return out


def run(spark: SparkSession, spec: str, log: str, trace_too: bool = False, debug: bool = False, say: Callable[[str], None] = print) -> int:
    """Monitors a log file with a specification's text; the number of violations."""
    monitor = Monitor(spec)
    trace = read_log(spark, log, timed=monitor.timed)
    violations = 0
    for name, p in monitor.spec.properties.items():
        say(f"{name}" + (" (anchored)" if p.anchored else ""))
    facts = fact_texts(trace, monitor.timed)
    if debug:
        for name in monitor.spec.properties:
            if not monitor.params[name]:
                say(f"===== {name} =====")
                for r in tree_rows(monitor, name, trace).orderBy("pos", "node").toLocalIterator():
                    say(f"{r.pos:>5}  {'  ' * r.depth}{r.formula} : {r.value}")
    for name in monitor.spec.properties:
        if monitor.params[name]:
            told = verdict_texts(monitor, name, trace).withColumnRenamed(name, "tag").where("tag <> 'holds'")
        else:
            told = monitor.violations(name, trace).select(F.col("pos").alias("_pos"), F.lit("VIOLATED").alias("tag"))
        for r in told.join(facts, F.col("_pos") == F.col("_at")).orderBy("_pos").toLocalIterator():
            violations += r.tag == "VIOLATED"
            if not (trace_too or debug):
                say(f"*** Violation of {name} at event {r._pos}: {r.fact}" if r.tag == "VIOLATED" else f"--- {name} at event {r._pos}: {r.fact} {r.tag}")
    if trace_too:
        for r in trace_table(monitor, trace).orderBy("pos").toLocalIterator():
            say(f"{r.pos:>5}  {r.fact:<28}  " + "   ".join(f"{n}: {r[n]}" for n in monitor.spec.properties))
    for name, params in monitor.params.items():
        if params:
            found = [(*region(monitor, name, trace, p).first(), p) for p, _ in params]
            never = any(kind == "false" for kind, _, _ in found)
            parts = [condition(*x) for x in found if x[0] != "true"]
            say(f"Parametric verdict for {name}: holds iff {'false' if never else ' & '.join(parts) or 'true'}")
    say(f"Processed {trace.axis.n} events, {violations} violation(s).")
    return violations


def main(args: list[str]) -> int:
    words = {a.removeprefix("--") for a in args if a.removeprefix("--") in FLAGS}
    files = [a for a in args if a.removeprefix("--") not in FLAGS]
    if len(files) != 2:
        print(USAGE)
        return 2
    with open(files[0], encoding="utf-8") as f:
        spec = f.read()
    spark = SparkSession.builder.appName("tracewright").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    return 1 if run(spark, spec, files[1], "trace" in words, "debug" in words) else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
