"""One specification for each feature on seeded random traces, against the definitions; errors and sources on known ones."""

import random

import pytest

from tests import naive
from tracewright.functions.pyfuncs import load_functions
from tracewright.plans import analysis
from tracewright.plans.compiler import NotMonitorable
from tracewright.plans.monitor import Monitor
from tracewright.plans.parser import SpecError, parse_spec
from tracewright.sources.trace import Trace, read_log, trace_of_text

#: Letters and small numbers; the last of each stand for values that no fact holds.
TEXTS, NUMBERS = ["a", "b", "#1", "#2", "#3"], [0, 1, 2, 3, -7, -8, -9]
PY = "python:\ndef size(d: str) -> int:\n    return len(d)\ndef odd(n: int) -> bool:\n    return n % 2 == 1\ndef half(n: int) -> int:\n    return n // 2\nend\n"
ROOM, LOAN = "pred enter(p) pred leave(p) pred open(d) pred shut(d) pred badge(p, d) ", "pred lend(k: Int) pred back(k: Int) pred pay(k: Int, m: Int) "

#: name, specification, predicates with a T (text) or N (number) for each argument.
SPECS = [
    ("relation under an interval", ROOM + "prop p : Forall d . shut(d) -> Exists p . @ [badge(p,d),shut(d))", "shut:T badge:TT"),
    ("two values of one key", LOAN + "prop p : Forall k . Forall m . Forall n . (@ P pay(k,m)) & pay(k,n) -> m < n", "pay:NN"),
    ("two values the other way", LOAN + "prop p : Forall k . Forall m . Forall n . (@ P pay(k,m)) & pay(k,n) -> !(n >= m)", "pay:NN"),
    ("greatest before, as a sum", LOAN + "prop p : Forall n . lend(n) -> Exists m . (@ P back(m)) & m + 1 > n", "lend:N back:N"),
    ("since, keyed", ROOM + "prop p : Forall p . leave(p) -> (!leave(p)) S enter(p)", "leave:T enter:T"),
    ("since, broken", ROOM + "prop p : Forall d . shut(d) -> (!shut(d)) Z open(d)", "shut:T open:T"),
    ("some value", "prop p : Exists f . P open(f)", "open:T shut:T"),
    ("macros with parameters", ROOM + "pred inside(x) = [enter(x),leave(x)) pred ajar(x) = [open(x),shut(x)) prop p : Forall q . Forall d . badge(q,d) -> inside(q) & ajar(d)", "enter:T leave:T open:T shut:T badge:TT"),
    ("arithmetic", LOAN + "prop p : Forall k . Forall m . pay(k,m) -> m * 2 - k >= -1", "pay:NN"),
    ("equal terms", LOAN + "prop p : Forall k . Forall m . lend(k) & back(m) -> m = k + 1", "lend:N back:N"),
    ("order of sorts unsaid", "prop p : Forall k . lend(k) -> k <= 2", "lend:N"),
    ("constants", LOAN + "prop p : !pay(1,2) & !(Exists k . pay(k,3))", "pay:NN"),
    ("names of one argument", ROOM + "prop p : Forall x . !badge(x,x)", "badge:TT"),
    ("no variables", "prop p : open -> [enter,leave)", "open: enter: leave:"),
    ("always so far", "prop p : H (open | enter)", "open: enter: leave:"),
    ("strict since", "prop p : enter Z open", "open: enter: leave:"),
    ("not the one before", "prop p : @ !open", "open: enter:"),
    ("iff", "prop p : (P open) <-> (P enter)", "open: enter:"),
    ("any value at all", "prop p : Forall x . P open(x)", "open:T"),
    ("some value not", "prop p : Exists x . !open(x)", "open:T"),
    ("two values not", "prop p : Exists x . Exists y . !(x = y) & !open(x)", "open:T"),
    ("once, timed", "prop p : Forall x . shut(x) -> P[<=3] open(x)", "open:T shut:T"),
    ("once, unkeyed guard", "prop p : shut -> P[1,3] open", "open: shut:"),
    ("once, old", "prop p : Forall x . shut(x) -> P[>=2] open(x)", "open:T shut:T"),
    ("once, at every position", "prop p : P[2,4] open", "open: shut:"),
    ("some value, timed", "prop p : Exists x . P[<=2] open(x)", "open:T shut:T"),
    ("since, timed", "prop p : Forall x . shut(x) -> (!leave(x)) S[<=4] open(x)", "open:T shut:T leave:T"),
    ("since, old", "prop p : Forall x . shut(x) -> (!leave(x)) S[2,*] open(x)", "open:T shut:T leave:T"),
    ("since, unkeyed break", "prop p : Forall x . shut(x) -> (!leave) S[1,5] open(x)", "open:T shut:T leave:"),
    ("since, held", "prop p : Forall x . shut(x) -> enter(x) S[<=4] open(x)", "open:T shut:T enter:T"),
    ("strict since, timed", "prop p : Forall x . open(x) -> (!leave(x)) Z[1,4] open(x)", "open:T leave:T"),
    ("historically, timed", "prop p : Forall x . shut(x) -> H[<=2] !leave(x)", "shut:T leave:T"),
    ("historically, range", "prop p : Forall x . shut(x) -> H[2,4] !leave(x)", "shut:T leave:T"),
    ("nested past", "prop p : P[<=4] (open & P[<=2] enter)", "open: enter:"),
    ("eventually, timed", "prop p : Forall x . open(x) -> F[<=3] shut(x)", "open:T shut:T"),
    ("eventually, range", "prop p : Forall x . open(x) -> F[2,5] shut(x)", "open:T shut:T"),
    ("eventually, at every position", "prop p : F[<=2] open", "open: shut:"),
    ("always, timed", "prop p : Forall x . open(x) -> G[<=3] !shut(x)", "open:T shut:T"),
    ("always, range", "prop p : G[1,3] open", "open: shut:"),
    ("until, timed", "prop p : Forall x . open(x) -> (!leave(x)) U[<=4] shut(x)", "open:T shut:T leave:T"),
    ("until, held", "prop p : Forall x . open(x) -> enter(x) U[<=4] shut(x)", "open:T shut:T enter:T"),
    ("until, range", "prop p : enter U[1,4] open", "open: enter:"),
    ("next", "prop p : X open", "open: shut:"),
    ("next, negated", "prop p : open -> !(X shut)", "open: shut:"),
    ("past around future", "prop p : P (F[<=2] open)", "open: shut:"),
    ("future around future", "prop p : Forall x . open(x) -> F[<=4] (enter(x) & F[<=2] shut(x))", "open:T enter:T shut:T"),
    ("future beside the past", "prop p : Forall x . open(x) -> (P enter(x)) & F[<=3] shut(x)", "open:T enter:T shut:T"),
    ("since of future", "prop p : enter S (F[<=2] open)", "open: enter:"),
    ("bound from data", LOAN + "prop p : Forall k . Forall m . pay(k,m) -> F[0,m] back(k)", "pay:NN back:N"),
    ("bound from data, past", LOAN + "prop p : Forall k . Forall m . pay(k,m) -> P[0,m] lend(k)", "pay:NN lend:N"),
    ("lower bound from data", LOAN + "prop p : Forall k . Forall m . pay(k,m) -> P[m,*] lend(k)", "pay:NN lend:N"),
    ("lower bound from data, negated", LOAN + "prop p : Forall k . Forall m . pay(k,m) -> !F[m,4] back(k)", "pay:NN back:N"),
    ("until, bound from data", LOAN + "prop p : Forall k . Forall m . pay(k,m) -> (!lend(k)) U[0,m] back(k)", "pay:NN back:N lend:N"),
    ("since, bound from data", LOAN + "prop p : Forall k . Forall m . pay(k,m) -> (!back(k)) S[m,*] lend(k)", "pay:NN back:N lend:N"),
    ("contains", 'prop p : Forall x . open(x) -> !(x contains "b")', "open:T"),
    ("function as a term", PY + "prop p : Forall x . open(x) -> size(x) < 2", "open:T"),
    ("function as an atom", PY + LOAN + "prop p : Forall k . lend(k) -> !odd(k)", "lend:N"),
    ("function that binds", PY + LOAN + "prop p : Forall k . lend(k) -> F (Exists m . back(m) & m = half(k))", "lend:N back:N"),
]


def events_of(rng, preds):
    kinds = [(name, kind) for name, _, kind in (x.partition(":") for x in preds.split())]
    out, ts = [], 0
    for _ in range(rng.randint(5, 9)):
        facts = {}
        for _ in range(rng.randint(0, 3)):
            name, kind = rng.choice(kinds)
            facts.setdefault(name, set()).add(tuple(rng.choice(TEXTS[:2]) if c == "T" else rng.choice(NUMBERS[:4]) for c in kind))
        out.append(({k: sorted(v) for k, v in facts.items()}, ts))
        ts += rng.choice([0, 1, 1, 2, 3])
    return out


@pytest.mark.parametrize("name,spec,preds", SPECS, ids=[x[0] for x in SPECS])
def test_feature(spark, name, spec, preds):
    m = Monitor(spec)
    parsed = parse_spec(spec)
    functions = load_functions(parsed.python)
    sorts = {v: m.sorts["p"].get(m.names["p"].get(v, v), "String") for v in {*m.names["p"], *m.sorts["p"]}} | {v: s for v, s in m.sorts["p"].items() if v not in m.names["p"]}
    called = {k: f.callable() for k, f in functions.items()}
    for seed in (1, 2):
        events = events_of(random.Random(f"{name}{seed}"), preds)
        want = naive.verdicts(m.formulas["p"], events, {"String": TEXTS, "Int": NUMBERS, "Real": NUMBERS}, sorts, called)
        got = {r.pos for r in m.violations("p", Trace.from_events(spark, events)).collect()}
        assert got == {i for i, ok in enumerate(want, 1) if not ok}, events


def trace(spark, *events):
    return Trace.from_events(spark, events)


def bad(spark, spec, *events):
    m = Monitor(spec)
    (name,) = m.spec.properties
    return sorted(r.pos for r in m.violations(name, trace(spark, *events)).collect())


def test_patterns(spark):
    say = lambda *words: ({"say": [(w,) for w in words]}, 0)
    user = 'prop p : Forall m . Forall u . say(m) & m matches "id={u}" -> ok(u)'
    assert bad(spark, user, ({"say": [("id=7",)], "ok": [("7",)]}, 0), ({"say": [("id=8",)], "ok": [("7",)]}, 1)) == [2]
    cut = 'prop p : Forall m . Forall a . Forall b . say(m) & m matches "{a}/{b}" -> pair(a,b)'
    both = [("q", "r/s"), ("q/r", "s")]
    assert bad(spark, cut, ({"say": [("q/r/s",)], "pair": both}, 0), ({"say": [("q/r/s",)], "pair": both[1:]}, 1)) == [2]
    twice = 'prop p : Forall m . Forall a . !(say(m) & m matches "{a}-{a}")'
    assert bad(spark, twice, say("xy-xy"), say("xy-yx"), say("-"), say("x-x-x-x")) == [1, 3, 4]
    rule = 'prop p : Forall m . Forall a . say(m) & m matches "...no {a:[0-9]+}" -> ok(a)'
    assert bad(spark, rule, ({"say": [("order no 42",)], "ok": [("42",), ("2",)]}, 0), say("no x"), say("no 4")) == [3]
    plain = [
        ('"...up...down..."', ["updown", "go up and down!", "up"], [3]),
        ('"a{:[0-9]+}b"', ["a12b", "ab", "a1b2b"], [2, 3]),
        ("/v[0-9.]*(rc|beta)?/", ["v1.2", "v", "v1rc", "1"], [4]),
        ('"x...x"', ["xx", "x", "x\nx"], [2]),
        ("/a.c+/", ["abcc", "a\nc", "ac"], [3]),
    ]
    for pattern, words, want in plain:
        assert bad(spark, f"prop p : Forall m . say(m) -> m matches {pattern}", *(say(w) for w in words)) == want, pattern


def test_several_properties(spark):
    m = Monitor("prop one : Forall x . b(x) -> P a(x)\nprop two anchored : F b(\"k\")\n// a remark\nprop three : a -> X b")
    got = sorted((r.property, r.pos, r.holds, r.determined_at) for r in m.run(trace(spark, ({"a": [("k",)]}, 0), ({"b": [("k",)]}, 1), ({"b": [("z",)]}, 2))).collect())
    assert got == [("one", 1, True, 1), ("one", 2, True, 2), ("one", 3, False, 3), ("three", 1, True, 1), ("three", 2, True, 2), ("three", 3, True, 3), ("two", 1, True, 2)]


def test_errors(spark):
    for wrong in ("prop p : P[<0] a", "prop p : P[7,4] a", "prop p : (a", 'prop p : Forall m . a(m) -> m matches "{u"', "pred m(x) = m(x) prop p : Forall y . m(y)", "pred m(x) = a(x) prop p : m", "prop p : F[n,m] a", "prop p : F[n,5] a & P[<=n] b", "pred a(x) prop p : Forall x . a(x) -> F[0,x] b", "pred a(x: Int) prop p : Forall x . a(x) & x contains \"q\""):
        with pytest.raises(ValueError):
            Monitor(wrong)
    for wrong in ("python:\ndef f(x) -> int:\n    return 1\nend\nprop p : true", "python:\ndef q(x: int) -> int:\n    return 1\nend\npred q(x) prop p : true", PY + "prop p : Forall d . a(d) -> size(d)"):
        with pytest.raises(ValueError):
            Monitor(wrong)
    with pytest.raises(ValueError):
        bad(spark, "prop p : P[<=5] a", {"a": [()]}, {"b": [()]})
    with pytest.raises(SpecError):
        Monitor("prop p : Forall x . nosuch(x) < 3")
    with pytest.raises(NotMonitorable):
        bad(spark, "pred a(x: Int) prop p : Forall x . (P a(x)) | x > 5", {"a": [(1,)]})
    assert analysis.has_future(Monitor("prop p : P (X a)").formulas["p"])


def test_traces_are_checked(spark):
    for events in ([({"a": [()]}, 5), ({"a": [()]}, 4)],):
        with pytest.raises(ValueError):
            trace(spark, *events)
    rows = spark.createDataFrame([(1, 0), (3, 1)], "pos long, ts long")
    with pytest.raises(ValueError):
        Trace(rows).axis
    with pytest.raises(ValueError):
        Trace(spark.createDataFrame([(1, 10), (2, 3), (3, 12)], "pos long, ts long")).check_order()
    Trace(spark.createDataFrame([(1, 3), (2, 3), (3, 12)], "pos long, ts long")).check_order()


def test_log_text(spark):
    t = trace_of_text(spark, "lend, k ,0\n\nback,k,2\nlend,m,9\nback,m,20\n", timed=True)
    m = Monitor("prop soon : Forall f . back(f) -> P[<=4] lend(f)")
    assert [(r.pos, r.holds) for r in m.verdicts("soon", t).orderBy("pos").collect()] == [(1, True), (2, True), (3, True), (4, False)]
    with pytest.raises(ValueError):
        trace_of_text(spark, "lend,k\n", timed=True)


def test_log_folder(spark, tmp_path):
    """Positions follow the files' names and the lines in them, whatever the files' sizes."""
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "0.csv").write_text("first,a\n")
    (tmp_path / "log" / "1.csv").write_text("".join(f"\nnext,{k}\n" for k in range(50)))
    (tmp_path / "log" / "2.csv").write_text("last,z\n")
    rows = read_log(spark, str(tmp_path / "log")).facts.orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(1, 53)) and rows[0].pred == "first" and rows[-1].pred == "last"
    assert [r.args[0] for r in rows[1:-1]] == [str(k) for k in range(50)]
