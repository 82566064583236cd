"""Properties as a guard and its goals: `Forall .. guard -> goal & goal & ..`, or goals alone, asked at every position."""

from __future__ import annotations

from dataclasses import dataclass

from tracewright.operators import relation as R
from tracewright.plans.analysis import has_future
from tracewright.plans.compiler import Compiler, NotMonitorable, negated
from tracewright.plans.formula import Logic, Not, Temporal
from tracewright.plans.monitor import Monitor, quantified
from tracewright.sources.trace import Trace


@dataclass(frozen=True)
class Goal:
    """formula, or its negation where flipped; op P H S F G U X with its bound, or None for a formula of the past without one."""

    formula: object
    flipped: bool

    @property
    def op(self) -> str | None:
        return self.formula.op if isinstance(self.formula, Temporal) else None


def _goal(f) -> Goal:
    flipped = False
    while isinstance(f, Not):
        f, flipped = f.body, not flipped
    return Goal(f, flipped)


def _conjuncts(f) -> list:
    return [*_conjuncts(f.left), *_conjuncts(f.right)] if isinstance(f, Logic) and f.op == "&" else [f]


class Goals:
    """The guard's points and the goals of a property; other shapes raise NotMonitorable."""

    def __init__(self, monitor: Monitor, name: str, trace: Trace):
        outer, body = quantified(monitor.formulas[name])
        if any(q.kind != "Forall" for q in outer):
            raise NotMonitorable(f"property {name}: only universal quantifiers may stand before a guard")
        self.name, self.trace, self.axis = name, trace, trace.axis
        self.compiler: Compiler = monitor.compiler(name, trace)
        given = isinstance(body, Logic) and body.op == "->"
        if given and has_future(body.left):
            raise NotMonitorable(f"property {name}: the guard asks for the future")
        self.guard = self.points(body.left, None) if given else R.everywhere(self.axis)
        if outer and not {q.var for q in outer} <= set(self.guard.vars):
            raise NotMonitorable(f"property {name}: the guard does not bind all variables")
        self.goals = [_goal(f) for f in _conjuncts(body.right if given else body)]

    def points(self, f, among: R.Rel | None, denied: bool = False) -> R.Rel:
        """The points where a formula holds (denied: fails), for bindings among the guard's."""
        value = self.compiler.evaluate(f, {})
        rel = self.compiler.finite(negated(value) if denied else value, {})
        if rel is None and among is not None:
            # over the guard's own bindings
            rel = self.compiler.finite(negated(value) if denied else value, {v: among.df.select(R.col(v)).distinct() for v in among.vars})
        if rel is None or among is not None and not set(rel.vars) <= set(among.vars):
            raise NotMonitorable(f"property {self.name}: a variable is bound neither by the guard nor by a fact")
        return R.spread_points(rel if rel.points else R.runs(rel, self.axis))

    def breaks(self, left) -> R.Rel:
        """Where the left side of a since or until fails, for the guard's bindings."""
        finite, rel = self.compiler.form(self.compiler.evaluate(left, {}), {})
        if not set(rel.vars) <= set(self.guard.vars):
            raise NotMonitorable(f"property {self.name}: the guard does not bind all variables")
        if not finite:
            return rel
        return R.gaps(rel, R.bindings(self.guard, rel.vars) if rel.vars else self.trace.spark.range(1).select(), self.axis)

    def asked(self, goal: Goal, low: int, high: int | None) -> R.Witness:
        """The question of a temporal goal; for H and G, for a counterexample."""
        f = goal.formula
        points = self.points(f.right, self.guard, denied=f.op in "HG")
        return R.Witness(points, low, high, f.op in "FGUX", breaks=self.breaks(f.left) if f.op in "SU" else None)

    def fails(self, goal: Goal) -> R.Rel:
        """The guard's points where a goal without parameters fails."""
        value = self.compiler.evaluate(goal.formula, {})
        got = self.compiler.restrict(self.guard, value if goal.flipped else negated(value), {})
        if got is None:
            raise NotMonitorable(f"property {self.name}: a variable is bound neither by the guard nor by a fact")
        return R.spread_points(got)
