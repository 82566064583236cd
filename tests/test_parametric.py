"""Bounds to be found, against every value of the parameter in turn by the definitions."""

import random

import pytest

from tests import naive
from tests.test_fixtures import events_of
from tracewright.plans.compiler import NotMonitorable
from tracewright.plans.formula import Bound, Logic, Not, Quant, Temporal
from tracewright.plans.monitor import Monitor
from tracewright.plans.parametric import constraints, region
from tracewright.sources.trace import Trace

MOST = 40


def with_value(f, values):
    """The formula with its parameters' values."""
    if isinstance(f, Quant):
        return Quant(f.kind, f.var, with_value(f.body, values))
    if isinstance(f, Not):
        return Not(with_value(f.body, values))
    if isinstance(f, Logic):
        return Logic(f.op, with_value(f.left, values), with_value(f.right, values))
    if isinstance(f, Temporal):
        b = f.bound and Bound(values.get(f.bound.low, f.bound.low), values.get(f.bound.high, f.bound.high))
        return Temporal(f.op, f.left and with_value(f.left, values), with_value(f.right, values), b)
    return f


SHAPES = [
    ("Forall x . open(x) -> F[<=n] shut(x)", "open:T shut:T"),
    ("Forall x . shut(x) -> P[<=n] open(x)", "open:T shut:T"),
    ("Forall x . shut(x) -> P[2,n] open(x)", "open:T shut:T"),
    ("Forall x . shut(x) -> P[>=n] open(x)", "open:T shut:T"),
    ("Forall x . open(x) -> F[n,5] shut(x)", "open:T shut:T"),
    ("Forall x . shut(x) -> (!leave(x)) S[<=n] open(x)", "open:T shut:T leave:T"),
    ("Forall x . shut(x) -> (!leave(x)) S[n,*] open(x)", "open:T shut:T leave:T"),
    ("Forall x . open(x) -> (!leave(x)) U[1,n] shut(x)", "open:T shut:T leave:T"),
    ("Forall x . open(x) -> (!leave) U[n,6] shut(x)", "open:T shut:T leave:"),
    ("Forall x . open(x) -> enter(x) U[<=n] shut(x)", "open:T shut:T enter:T"),
    ("Forall x . open(x) -> G[<=n] !leave(x)", "open:T leave:T"),
    ("Forall x . open(x) -> G[n,5] !leave(x)", "open:T leave:T"),
    ("Forall x . shut(x) -> H[n,*] !leave(x)", "shut:T leave:T"),
    ("Forall x . shut(x) -> !(P[1,n] leave(x))", "shut:T leave:T"),
    ("G[<=n] open", "open: shut:"),
    ("F[<=n] open", "open: shut:"),
    ("Forall x . open(x) -> F[<=4] (enter(x) & F[<=n] shut(x))", "open:T enter:T shut:T"),
    ("Forall x . shut(x) -> P (enter(x) & P[<=n] open(x))", "open:T enter:T shut:T"),
    ("Forall x . shut(x) -> P[1,4] (enter(x) & (!leave(x)) S[n,*] open(x))", "open:T enter:T shut:T leave:T"),
    ("Forall x . open(x) -> F[<=5] (enter(x) & G[<=n] !leave(x))", "open:T enter:T leave:T"),
    ("Forall x . shut(x) -> (P enter(x)) & P[<=n] open(x)", "open:T enter:T shut:T"),
]


def told(rows):
    """A constraint as the values that satisfy it, up to MOST."""
    kind, bound = rows
    return [n for n in range(MOST) if kind == "true" or kind == "ge" and n >= bound or kind == "le" and n <= bound]


@pytest.mark.parametrize("formula,preds", SHAPES, ids=[f for f, _ in SHAPES])
def test_each_value(spark, formula, preds):
    m = Monitor(f"prop p : {formula}")
    names = {v: "String" for v in {*m.names["p"], *m.sorts["p"]}}
    for seed in (1, 2, 3):
        events = events_of(random.Random(f"{formula}{seed}"), preds)
        trace = Trace.from_events(spark, events)
        got = sorted(constraints(m, "p", trace).collect())
        holds = [naive.verdicts(with_value(m.formulas["p"], {"n": n}), events, {"String": ["a", "b", "#1"]}, names) for n in range(MOST)]
        for r in got:
            assert told((r.kind, r.bound)) == [n for n in range(MOST) if holds[n][r.pos - 1]], (events, r)
        whole = region(m, "p", trace).first()
        assert told((whole.kind, whole.bound)) == [n for n in range(MOST) if all(holds[n])]


def test_two_parameters(spark):
    m = Monitor("prop p : Forall x . enter(x) -> (P[<=n] open(x)) & (F[k,7] shut(x))")
    names = {v: "String" for v in {*m.names["p"], *m.sorts["p"]}}
    for seed in (4, 5):
        events = events_of(random.Random(seed), "open:T enter:T shut:T")
        trace = Trace.from_events(spark, events)
        by = {p: {r.pos: told((r.kind, r.bound)) for r in constraints(m, "p", trace, p).collect()} for p in "nk"}
        for n in range(0, 12, 2):
            for k in range(0, 9, 2):
                want = naive.verdicts(with_value(m.formulas["p"], {"n": n, "k": k}), events, {"String": ["a", "b", "#1"]}, names)
                assert [n in by["n"][i] and k in by["k"][i] for i in range(1, len(events) + 1)] == want
    with pytest.raises(ValueError):
        constraints(m, "p", trace, "z")


def test_other_shapes(spark):
    trace = Trace.from_events(spark, [({"a": [()]}, 0)])
    for formula in ("(F[<=n] a) | b", "a -> P (H[<=n] b)", "Forall x . c(x) -> F[<=n] d(x,y)", "a -> (b Z[<=n] a)", "a <-> F[<=n] b"):
        with pytest.raises((NotMonitorable, ValueError)):
            constraints(Monitor(f"prop p : {formula}"), "p", trace).collect()
