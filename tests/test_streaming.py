"""The streaming monitor against the batch one, on events that come in several micro-batches."""

import random

import pytest

from tests.test_fixtures import events_of
from tracewright.plans.compiler import NotMonitorable
from tracewright.plans.monitor import Monitor
from tracewright.sources.trace import FACTS, Trace
from tracewright.streaming.monitor import END, Binding, Rule, plan, verdicts

SHAPES = [
    "Forall x . shut(x) -> P[<=4] open(x)",
    "Forall x . shut(x) -> (!leave(x)) S[1,6] open(x)",
    "Forall x . shut(x) -> H[<=3] !leave(x)",
    "Forall x . open(x) -> F[1,4] shut(x)",
    "Forall x . open(x) -> (!leave(x)) U[<=5] shut(x)",
    "Forall x . open(x) -> G[<=4] !leave(x)",
]


def per_binding(events, formula):
    """Position -> the one binding of the guard there; others are taken out."""
    guard = "open" if " open(x) ->" in formula else "shut"
    for facts, _ in events:
        if guard in facts:
            facts[guard] = facts[guard][:1]
    return guard


@pytest.mark.parametrize("formula", SHAPES)
def test_state_machine(formula, spark):
    """The steps of one binding after the other, against the batch plan."""
    m = Monitor(f"prop p : {formula}")
    rule, parts, _ = plan(m, "p")
    for seed in range(3):
        events = events_of(random.Random(f"{formula}{seed}"), "open:T shut:T leave:T")
        per_binding(events, formula)
        bad = {r.pos for r in m.violations("p", Trace.from_events(spark, events)).collect()}
        got = []
        for x in ("a", "b"):
            binding = Binding(rule, None)
            for pos, (facts, ts) in enumerate(events, 1):
                mine = {part for p, part in parts if (x,) in facts.get(p.name, [])}
                if mine:
                    got += binding.step(pos, ts, mine)
                binding = Binding(rule, binding.told())
            got += binding.passed(10**6, None)
        assert {pos for pos, holds, _ in got if not holds} == bad


@pytest.mark.parametrize("formula", [SHAPES[1], SHAPES[4], SHAPES[5]])
def test_stream_equals_batch(spark, tmp_path, formula):
    m = Monitor(f"prop p : {formula}")
    rng, events = random.Random(formula), []
    for k in range(6):
        last = events[-1][1] + 1 if events else 0
        events += [(f, t + last) for f, t in events_of(rng, "open:T shut:T leave:T")]
    guard = per_binding(events, formula)
    rows = [(pos, ts, p, list(args)) for pos, (facts, ts) in enumerate(events, 1) for p, some in facts.items() for args in some]
    # a position's facts come together
    cut = [[r for r in rows if low < r[0] <= high] for low, high in ((0, 12), (12, 27), (27, 10**5))] + [[(10**6, 10**6, END, [])]]
    for k, part in enumerate(cut):
        spark.createDataFrame(part, FACTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"k={k}"))
    stream = spark.readStream.schema(FACTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = verdicts(m, "p", stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = {r.pos for r in m.violations("p", Trace.from_events(spark, events)).collect()}
    assert {r.pos for r in got if not r.holds} == want
    assert sorted(r.pos for r in got) == [pos for pos, (facts, _) in enumerate(events, 1) if guard in facts]


def test_other_shapes():
    for formula in ("a -> P b", "Forall x . a(x) -> P b(x,x)"):
        m = Monitor(f"prop p : {formula}")
        assert plan(m, "p")[0] == Rule("P", 0, None) if formula == "a -> P b" else True
    for formula in ("Forall x . a(x) -> P (b(x) & c(x))", "Forall x . a(x) -> H b(x)", "P a", "Forall x . a(x) -> P[<=n] b(x)", "Forall x . a(x) -> P b", "Exists x . a(x) -> P b(x)"):
        with pytest.raises(NotMonitorable):
            plan(Monitor(f"prop p : {formula}"), "p")
