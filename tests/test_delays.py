"""The position at which a verdict is known, against what a prefix of the trace tells."""

import random

import pytest

from tests import naive
from tests.test_fixtures import events_of
from tracewright.plans.delays import delayed
from tracewright.plans.formula import Logic, Not, Quant, Temporal
from tracewright.plans.monitor import Monitor
from tracewright.sources.trace import Trace

SHAPES = [
    ("Forall x . open(x) -> F[<=3] shut(x)", "open:T shut:T"),
    ("Forall x . open(x) -> F[2,5] shut(x)", "open:T shut:T"),
    ("Forall x . open(x) -> F shut(x)", "open:T shut:T"),
    ("Forall x . open(x) -> G[<=3] !shut(x)", "open:T shut:T"),
    ("Forall x . open(x) -> !F[1,3] shut(x)", "open:T shut:T"),
    ("Forall x . open(x) -> (!leave(x)) U[<=4] shut(x)", "open:T shut:T leave:T"),
    ("Forall x . open(x) -> (!leave(x)) U shut(x)", "open:T shut:T leave:T"),
    ("Forall x . open(x) -> (P enter(x)) & F[<=3] shut(x)", "open:T shut:T enter:T"),
    ("Forall x . open(x) -> (F[<=2] shut(x)) & G[<=4] !leave(x)", "open:T shut:T leave:T"),
    ("open -> X shut", "open: shut:"),
    ("F[<=2] open", "open: shut:"),
    ("G[<=4] open", "open: shut:"),
    ("enter U[<=4] open", "open: enter:"),
]


class Online:
    """Three values from the events so far: True, False, or None while it is open."""

    def __init__(self, formula, events, sorts, seen):
        self.now = naive.Naive(events[:seen], {"String": ["a", "b", "#1"]}, sorts)
        self.events, self.seen = events, seen

    def value(self, f, i, env):
        if isinstance(f, Quant):
            return self.every([self.value(f.body, i, env | {f.var: v}) for v in ("a", "b", "#1")])
        if isinstance(f, Not):
            x = self.value(f.body, i, env)
            return None if x is None else not x
        if isinstance(f, Logic) and f.op in ("&", "->"):
            a, b = self.value(f.left, i, env), self.value(f.right, i, env)
            return self.every([a, b]) if f.op == "&" else self.every([True if a is False else b if a else None])
        if isinstance(f, Temporal) and f.op in "FGUX":
            return self.future(f, i, env)
        return self.now.holds(f, i, env)

    @staticmethod
    def every(parts):
        return False if False in parts else None if None in parts else True

    def future(self, f, i, env):
        if f.op == "X":
            return self.now.holds(f.right, i + 1, env) if i < self.seen else None
        low, high = (0, None) if f.bound is None else (f.bound.low, f.bound.high)
        for j in range(i, self.seen + 1):
            far = 0 if f.bound is None else self.events[j - 1][1] - self.events[i - 1][1]
            if high is not None and far > high:
                return f.op == "G"
            if far >= low and self.now.holds(f.right, j, env) != (f.op == "G"):
                return f.op != "G"
            if f.op == "U" and not self.now.holds(f.left, j, env):
                return False
        return None


@pytest.mark.parametrize("formula,preds", SHAPES, ids=[f for f, _ in SHAPES])
def test_prefixes(spark, formula, preds):
    m = Monitor(f"prop p : {formula}")
    f, sorts = m.formulas["p"], {v: "String" for v in {*m.names["p"], *m.sorts["p"]}}
    for seed in (1, 2, 3):
        events = events_of(random.Random(f"{formula}{seed}"), preds)
        want = []
        for i in range(1, len(events) + 1):
            known = next((j for j in range(i, len(events) + 1) if Online(f, events, sorts, j).value(f, i, {}) is not None), None)
            want.append((i, naive.verdicts(f, events, {"String": ["a", "b", "#1"]}, sorts)[i - 1], known))
        got = sorted(tuple(r) for r in delayed(m, "p", Trace.from_events(spark, events)).collect())
        assert got == want, events


def test_without_times(spark):
    trace = Trace.from_events(spark, [{"a": [()]}, {"b": [()]}, {"a": [()]}])
    assert [tuple(r) for r in Monitor("prop p : a -> F b").verdicts("p", trace).orderBy("pos").collect()] == [(1, "p", True, 2), (2, "p", True, 2), (3, "p", False, None)]
