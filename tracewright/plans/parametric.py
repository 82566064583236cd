"""Properties with time bounds to be found: for which values of a parameter each position holds.

Covers `guard -> goal & goal ..` (goals.py) where a goal with a parameter is P, F, S, U, H or G
with one symbolic bound, or P or F around such a goal beside a formula without one. A verdict
is monotone in its parameter, so it is a threshold: the witness nearest in time decides an
upper bound, the farthest within the other bound a lower one; for H and G the counterexample
does. Bindings and goals are folded by the strictest threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import relation as R
from tracewright.plans.analysis import parameters
from tracewright.plans.compiler import NotMonitorable
from tracewright.plans.formula import Temporal
from tracewright.plans.goals import Goal, Goals, _conjuncts, _goal
from tracewright.plans.monitor import Monitor
from tracewright.sources.trace import Trace


@dataclass(frozen=True)
class Threshold:
    """rows: the guard's columns, d and always: the parameter must be at least (rising) or at most d; null d: never, or always if that is set."""

    rows: DataFrame
    rising: bool


def _bounds(f: Temporal) -> tuple[bool, int, int | None]:
    """Whether the upper bound is the parameter, and the bounds without it."""
    upper = isinstance(f.bound.high, str)
    return upper, 0 if isinstance(f.bound.low, str) else f.bound.low, None if upper else f.bound.high


def _own(goals: Goals, goal: Goal, guard: R.Rel) -> Threshold:
    """The threshold of a goal whose own bound is the parameter."""
    f = goal.formula
    if f.op not in "PFSUHG":
        raise NotMonitorable(f"property {goals.name}: no parameter can be found in {f.op}")
    upper, low, high = _bounds(f)
    asked = goals.asked(goal, low, high)
    got = R.newest(guard, asked, goals.axis, times=True) if upper else R.oldest(guard, asked, goals.axis)
    found = R.unbroken(asked) if upper else F.col("_w").isNotNull()
    d = F.when(found, F.col("_s") - F.col("_ws"))
    # a witness wants the parameter to reach it, a counterexample wants it not to
    denied = (f.op in "HG") != goal.flipped
    if denied:
        d = d - 1 if upper else d + 1
    rows = got.select(*guard.df.columns, d.alias("d"), (~found if denied else F.lit(False)).alias("always"))
    rows = rows.withColumn("d", F.when(F.col("d") >= 0, F.col("d")))
    return Threshold(rows, upper != denied)


def _around(goals: Goals, goal: Goal) -> Threshold:
    """P or F with plain bounds around a goal with a parameter and formulas without one."""
    f = goal.formula
    inner = [_goal(p) for p in _conjuncts(f.right)]
    with_parameter = [g for g in inner if parameters(g.formula)]
    plain = [p for p, g in zip(_conjuncts(f.right), inner, strict=True) if g not in with_parameter]
    if f.op not in "PF" or goal.flipped or len(with_parameter) != 1 or not plain:
        raise NotMonitorable(f"property {goals.name}: a parameter may stand inside P or F only, beside what binds its variables")
    body = plain[0]
    for p in plain[1:]:
        body = type(f.right)("&", body, p)
    beside = goals.points(body, goals.guard)
    found = _threshold(goals, with_parameter[0], beside)
    low, high = (0, None) if f.bound is None else (f.bound.low, f.bound.high)
    sign = -1 if f.op == "F" else 1
    pick, axis = (F.min if found.rising else F.max), goals.axis
    # a witness that no value satisfies counts for nothing; one that all satisfy asks for no more than 0, or allows the most
    free = F.lit(0 if found.rising else 2**40).cast("long")
    tell = found.rows.withColumn("_x", F.when(F.col("always"), free).otherwise(F.col("d"))).where("_x is not null")
    tell = tell if beside.stamp else axis.at(tell, "f", "s")
    now = goals.guard.df if goals.guard.stamp else axis.at(goals.guard.df, "f", "s")
    ask = now.select(*goals.guard.df.columns, (F.col("f") * sign).alias("_o"), (F.col("s") * sign).alias("_s"), F.lit(1).alias("_k"))
    both = ask.unionByName(tell.select(*beside.keys, (F.col("f") * sign).alias("_o"), (F.col("s") * sign).alias("_s"), F.lit(0).alias("_k"), "_x"), allowMissingColumns=True)
    keyed = Window.partitionBy(*(beside.keys or [F.lit(0)]))
    if f.bound is None or low == 0 and high is None:
        best = pick("_x").over(keyed.orderBy("_o", "_k").rowsBetween(Window.unboundedPreceding, 0))
    else:
        first = Window.unboundedPreceding if high is None else -high
        best = pick("_x").over(keyed.orderBy("_s").rangeBetween(first, -low if low else -1))
        if low == 0:  # of the same time, what is not behind
            here = pick("_x").over(Window.partitionBy(*beside.keys, "_s").orderBy("_o", "_k").rowsBetween(Window.unboundedPreceding, 0))
            best = (F.least if found.rising else F.greatest)(best, here)
    got = both.withColumn("_best", best).where("_k = 1")
    always = F.coalesce(F.col("_best") == free, F.lit(False)) if not found.rising else F.lit(False)
    rows = got.select(*goals.guard.df.columns, F.when(~always, F.col("_best")).alias("d"), always.alias("always"))
    return Threshold(rows, found.rising)


def _threshold(goals: Goals, goal: Goal, guard: R.Rel) -> Threshold:
    f = goal.formula
    if not isinstance(f, Temporal):
        raise NotMonitorable(f"property {goals.name}: a parameter is found in temporal goals only")
    if f.bound and any(isinstance(x, str) for x in (f.bound.low, f.bound.high)):
        return _own(goals, goal, guard)
    if guard is not goals.guard:
        raise NotMonitorable(f"property {goals.name}: a parameter lies too deep")
    return _around(goals, goal)


def constraints(monitor: Monitor, name: str, trace: Trace, parameter: str | None = None) -> DataFrame:
    """pos, kind, bound: 'true', 'false', 'ge' (parameter >= bound) or 'le' (parameter <= bound) for each position.

    With several parameters, each in a goal of its own, a position holds where all of them
    satisfy their own constraint; parameter says whose is asked for (the first one's, if none).
    """
    found = [p for p, _ in monitor.params[name]]
    parameter = parameter or found[0]
    if parameter not in found:
        raise ValueError(f"property {name} has no parameter {parameter}")
    goals = Goals(monitor, name, trace)
    goals.axis.timed()
    parts, rising = [], True
    for goal in goals.goals:
        mine = [p for p, _ in parameters(goal.formula)]
        if not mine:
            parts.append(goals.fails(goal).df.select(F.col("f").alias("_pos"), F.lit(None).cast("long").alias("d"), F.lit(True).alias("never")))
            continue
        got = _threshold(goals, goal, goals.guard)
        never = F.col("d").isNull() & ~F.col("always")
        if mine == [parameter]:
            rising = got.rising
            parts.append(got.rows.select(F.col("f").alias("_pos"), "d", never.alias("never")))
        else:  # what another parameter asks for is told there, but where no value of it will do
            parts.append(got.rows.where(never).select(F.col("f").alias("_pos"), F.lit(None).cast("long").alias("d"), F.lit(True).alias("never")))
    asked = parts[0]
    for more in parts[1:]:
        asked = asked.unionByName(more)
    each = asked.groupBy("_pos").agg((F.max if rising else F.min)("d").alias("d"), F.max("never").alias("never"))
    positions = trace.positions.select("pos")
    if monitor.spec.properties[name].anchored:
        positions = positions.where("pos = 1")
    kind = F.when(F.col("never"), "false").when(F.col("d").isNull(), "true").otherwise("ge" if rising else "le")
    return positions.join(each, F.col("pos") == F.col("_pos"), "left").select("pos", kind.alias("kind"), F.when(~F.col("never"), F.col("d")).alias("bound"))


def region(monitor: Monitor, name: str, trace: Trace, parameter: str | None = None) -> DataFrame:
    """kind, bound in one row: the values of a parameter for which every position holds."""
    got = constraints(monitor, name, trace, parameter).agg(
        F.max(F.col("kind") == "false").alias("none"), F.max(F.when(F.col("kind") == "ge", F.col("bound"))).alias("ge"), F.min(F.when(F.col("kind") == "le", F.col("bound"))).alias("le")
    )
    none = F.coalesce("none", F.lit(False))
    kind = F.when(none, "false").when(F.col("ge").isNotNull(), "ge").when(F.col("le").isNotNull(), "le").otherwise("true")
    return got.select(kind.alias("kind"), F.when(~none, F.coalesce("ge", "le")).alias("bound"))
