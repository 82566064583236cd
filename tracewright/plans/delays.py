"""When a verdict is known: the position at which an online monitor could tell it.

Covers `guard -> goal & goal ..` (goals.py) where a goal is of the past, or F, G, U or X with
plain bounds on formulas of the past, negated or not. A witness makes F and U known at its own
position, a counterexample G; a window without one is known when a later time shows that it
has passed, an until when its run breaks, X one position on. What only the end of the trace
tells has no position (null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import relation as R
from tracewright.plans.analysis import has_future
from tracewright.plans.compiler import NotMonitorable
from tracewright.plans.formula import Temporal
from tracewright.plans.goals import Goal, Goals
from tracewright.plans.monitor import Monitor
from tracewright.sources.trace import Trace


def _known(goals: Goals, goal: Goal) -> DataFrame:
    """pos, ok and at: each binding's value of a goal, and the position where it is known (null: at the end)."""
    f, axis = goal.formula, goals.axis
    if not has_future(f):
        bad = goals.fails(goal).df.select(F.col("f").alias("pos"))
        return bad.select("pos", F.lit(False).alias("ok"), F.col("pos").alias("at"))
    if not isinstance(f, Temporal) or f.op not in "XFGU" or has_future(f.right) or f.left is not None and has_future(f.left):
        raise NotMonitorable(f"property {goals.name}: the position where a verdict is known is found for goals with one future operator only")
    low, high = (0, None) if f.bound is None else (f.bound.low, f.bound.high)
    if isinstance(low, str) or isinstance(high, str):
        raise NotMonitorable(f"property {goals.name}: a verdict's delay needs plain bounds")
    if f.op == "X":
        bad = goals.fails(goal).df.select(*goals.guard.keys, F.col("f"), F.lit(False).alias("ok"))
        got = goals.guard.df.select(*goals.guard.keys, "f").join(bad, [*goals.guard.keys, "f"], "left")
        return got.select(F.col("f").alias("pos"), F.coalesce("ok", F.lit(True)).alias("ok"), F.when(F.col("f") < axis.n, F.col("f") + 1).alias("at"))
    if f.bound is None and axis.first is None:
        axis = R.Axis(goals.trace.positions.select("pos", F.col("pos").alias("ts")), axis.n, 1, axis.n)
        guard = R.Rel(goals.guard.vars, goals.guard.df.drop("s"), True)
    else:
        guard = goals.guard
    asked = goals.asked(goal, low, high)
    if axis is not goals.axis:
        asked = R.replace(asked, points=R.Rel(asked.points.vars, asked.points.df.drop("s"), True))
    got = R.newest(guard, asked, axis).withColumn("_found", R.unbroken(asked))
    end = F.lit(None).cast("long")
    if high is not None:
        got = axis.first_from(got.withColumn("_over", -F.col("_s") + high + 1), F.col("_over"), "_late").drop("_over")
        end = F.when(F.col("_late") <= axis.n, F.col("_late"))
    if f.op == "U":
        end = F.least(end, F.when(F.col("_e").isNotNull(), -F.least("_e", "_o")))
    found = F.col("_found") if f.op != "G" else ~F.col("_found")
    return got.select(F.col("f").alias("pos"), (~found if goal.flipped else found).alias("ok"), F.when(F.col("_found"), -F.col("_w")).otherwise(end).alias("at"))


def delayed(monitor: Monitor, name: str, trace: Trace) -> DataFrame:
    """pos, holds, determined_at of each position; a violation is known with its first binding's, a verdict that holds with the last one's."""
    goals = Goals(monitor, name, trace)
    told = None
    for goal in goals.goals:
        got = _known(goals, goal)
        told = got if told is None else told.unionByName(got)
    bad, open_ = ~F.col("ok"), F.col("at").isNull()
    each = told.groupBy(F.col("pos").alias("_pos")).agg(
        F.max(bad).alias("bad"), F.min(F.when(bad, F.col("at"))).alias("soon"), F.max("at").alias("late"), F.max(open_).alias("open")
    )
    positions = trace.positions.select("pos")
    if monitor.spec.properties[name].anchored:
        positions = positions.where("pos = 1")
    bad = F.coalesce("bad", F.lit(False))
    at = F.when(F.col("_pos").isNull(), F.col("pos")).when(bad, F.col("soon")).when(~F.col("open"), F.greatest("late", "pos"))
    return positions.join(each, F.col("pos") == F.col("_pos"), "left").select("pos", (~bad).alias("holds"), at.alias("determined_at"))
