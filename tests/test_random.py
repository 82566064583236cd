"""Random formulas and traces with repeated timestamps against the definitions."""

import random
from functools import reduce

import pytest

from tests import naive

from tracewright.plans.formula import Bound, Compare, Logic, Not, Pred, Quant, Spec, Property, Temporal, Var, show
from tracewright.plans.monitor import Monitor
from tracewright.sources.trace import Trace


def bound(rng):
    low = rng.randint(0, 3)
    high = None if rng.random() < 0.3 else low + rng.randint(0, 4)
    return Bound(low, high, f"[{low},{'*' if high is None else high}]")


def formula(rng, depth, atom):
    """One of the connectives and temporal operators over smaller formulas."""
    if depth == 0:
        return atom(rng)
    sub = lambda: formula(rng, depth - 1, atom)
    shape = rng.choice(["!", "&", "|", "->", "<->", "@", "X", "P", "H", "F", "G", "S", "Z", "U", "I", "tP", "tH", "tF", "tG", "tS", "tZ", "tU"])
    if shape == "!":
        return Not(sub())
    if shape in ("&", "|", "->", "<->"):
        return Logic(shape, sub(), sub())
    op = shape[-1]
    b = bound(rng) if shape[0] == "t" else None
    return Temporal(op, None if op in "@XPHFG" else sub(), sub(), b)


def check(spark, cases):
    """cases: (formula, events, sorts, domains). All plans run as one job."""
    plans, wanted = [], []
    for k, (f, events, sorts, domains) in enumerate(cases):
        trace = Trace.from_events(spark, events)
        m = Monitor(Spec(properties={"p": Property("p", f)}))
        plans.append(m.violations("p", trace).selectExpr(f"{k} as k", "pos"))
        wanted.append({i for i, ok in enumerate(naive.verdicts(f, events, domains, sorts), 1) if not ok})
    got = [set() for _ in cases]
    for a in range(0, len(plans), 4):
        for r in reduce(lambda x, y: x.unionAll(y), plans[a : a + 4]).collect():
            got[r.k].add(r.pos)
    wrong = [(show(c[0]), c[1], "got", sorted(g), "wanted", sorted(w)) for c, g, w in zip(cases, got, wanted) if g != w]
    assert not wrong, wrong[0]


@pytest.mark.parametrize("seed", range(4))
def test_propositional(spark, seed):
    rng = random.Random(seed)
    cases = []
    for _ in range(12):
        f = formula(rng, rng.choice([1, 2, 2, 3]), lambda r: Pred(r.choice("pqr")))
        cases.append((f, naive.random_events(rng, [("p", 0), ("q", 0), ("r", 0)], ["-"]), {}, {}))
    check(spark, cases)


@pytest.mark.parametrize("seed", range(4))
def test_keyed(spark, seed):
    """Forall x . a(x) -> body, where the body has x, or y under a quantifier of its own, or neither."""
    rng = random.Random(100 + seed)

    def atom(r):
        kind = r.random()
        if kind < 0.6:
            return Pred(r.choice("bc"), (Var("x"),))
        if kind < 0.75:
            return Pred("p")
        inner = Pred("d", (Var("x"), Var("y"))) if r.random() < 0.5 else Logic("&", Pred("b", (Var("y"),)), Not(Compare("=", Var("x"), Var("y"))))
        return Quant("Exists", "y", inner)

    cases = []
    for _ in range(8):
        f = Quant("Forall", "x", Logic("->", Pred("a", (Var("x"),)), formula(rng, rng.choice([1, 2]), atom)))
        events = naive.random_events(rng, [("a", 1), ("b", 1), ("c", 1), ("d", 2), ("p", 0)], ["1", "2", "3"], 8)
        cases.append((f, events, {"x": "String", "y": "String"}, {"String": ["1", "2", "3", "#1", "#2", "#3"]}))
    check(spark, cases)


@pytest.mark.parametrize("seed", range(2))
def test_two_variables(spark, seed):
    """Runs and witnesses with different variables."""
    rng = random.Random(200 + seed)
    x, y = Var("x"), Var("y")
    atoms = [Pred("b", (x,)), Pred("c", (y,)), Pred("d", (x, y)), Pred("d", (y, x)), Not(Pred("b", (y,))), Not(Pred("d", (x, y)))]
    cases = []
    for _ in range(8):
        op = rng.choice("SZU")
        body = Temporal(op, rng.choice(atoms), rng.choice(atoms), bound(rng) if rng.random() < 0.5 else None)
        guard = Logic("&", Pred("a", (x,)), Pred("e", (y,)))
        f = Quant("Forall", "x", Quant("Forall", "y", Logic("->", guard, body)))
        events = naive.random_events(rng, [("a", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 1)], ["1", "2"], 8)
        for e, _ in events[::2]:
            e.setdefault("a", [("1",)])
            e.setdefault("e", [("2",)])
        cases.append((f, events, {"x": "String", "y": "String"}, {"String": ["1", "2", "#1", "#2", "#3"]}))
    check(spark, cases)


@pytest.mark.parametrize("seed", range(2))
def test_cut_scans(spark, monkeypatch, seed):
    """The same with scans cut in ranges of two rows, keyed ones, too."""
    from tracewright.operators import relation

    for name, value in (("RANGE_ROWS", 2), ("HOT_ROWS", 3), ("FINE", 2), ("CUTS", 2)):
        monkeypatch.setattr(relation, name, value)
    rng = random.Random(300 + seed)
    cases = []
    for _ in range(3):
        f = formula(rng, 1, lambda r: Pred(r.choice("pqr")))
        cases.append((f, naive.random_events(rng, [("p", 0), ("q", 0), ("r", 0)], ["-"]), {}, {}))
        body = formula(rng, 1, lambda r: Pred(r.choice("bc"), (Var("x"),)))
        f = Quant("Forall", "x", Logic("->", Pred("a", (Var("x"),)), body))
        events = naive.random_events(rng, [("a", 1), ("b", 1), ("c", 1)], ["1", "2"], 8)
        cases.append((f, events, {"x": "String"}, {"String": ["1", "2", "#1"]}))
    check(spark, cases)
