"""Online monitoring with Structured Streaming: verdicts as the events come in.

Covers `Forall x .. . guard(x,..) -> goal` where the goal is P, S, H, F, U or G with plain bounds on
one predicate, a since's or until's left side is `!pred(x,..)`, H's and G's body `!pred(x,..)`, and
every predicate has the guard's variables. Each binding is a key with a state of its own: its newest
witnesses, its last break, its open obligations. An obligation closes with a witness or a break of
its binding, or when the watermark shows that its window has passed; so a stream ends with a
row of the predicate END and a late time, which closes every bounded window.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.plans.compiler import NotMonitorable
from tracewright.plans.formula import Logic, Not, Pred, Temporal, Var
from tracewright.plans.monitor import Monitor, quantified

END = "__end__"
OUT = "key string, pos long, holds boolean, determined_at long"
BREAK, WITNESS, GUARD = 0, 1, 2
#: Rows up to the watermark are dropped: with a delay of a second and times later by this many, those at the
#: newest time so far, and at time 0, are not. A watermark then tells that no time before it, less SHIFT - 1, comes.
SHIFT = 2


@dataclass(frozen=True)
class Rule:
    """What a binding's state machine does: op, bounds, and whether a witness is a counterexample."""

    op: str
    low: int
    high: int | None

    @property
    def future(self) -> bool:
        return self.op in "FUG"

    @property
    def denies(self) -> bool:
        return self.op in "HG"


def _predicate(f, name: str) -> Pred:
    if not isinstance(f, Pred) or not all(isinstance(t, Var) for t in f.args) or len({t.name for t in f.args}) < len(f.args):
        raise NotMonitorable(f"property {name}: a stream is monitored on predicates of distinct variables")
    return f


def _denied(f, name: str) -> Pred:
    if not isinstance(f, Not):
        raise NotMonitorable(f"property {name}: a stream needs `!pred` there")
    return _predicate(f.body, name)


def plan(monitor: Monitor, name: str) -> tuple[Rule, list[tuple[Pred, int]], list[str]]:
    """The rule, each predicate with its part in it, and the key's variables."""
    outer, body = quantified(monitor.formulas[name])
    if any(q.kind != "Forall" for q in outer) or not (isinstance(body, Logic) and body.op == "->" and isinstance(body.right, Temporal) and body.right.op in "PSHFUG"):
        raise NotMonitorable(f"property {name}: a stream is monitored for `guard -> goal` only")
    goal = body.right
    low, high = (0, None) if goal.bound is None else (goal.bound.low, goal.bound.high)
    if isinstance(low, str) or isinstance(high, str):
        raise NotMonitorable(f"property {name}: a stream needs plain bounds")
    guard = _predicate(body.left, name)
    parts = [(guard, GUARD), ((_denied if goal.op in "HG" else _predicate)(goal.right, name), WITNESS)]
    if goal.op in "SU":
        parts.append((_denied(goal.left, name), BREAK))
    key = [t.name for t in guard.args]
    if any({t.name for t in p.args} != set(key) for p, _ in parts):
        raise NotMonitorable(f"property {name}: every predicate must have the guard's variables")
    return Rule(goal.op, low, high), parts, key


class Binding:
    """The state of one key, and its steps in order of position."""

    def __init__(self, rule: Rule, told: str | None):
        self.rule = rule
        #: newest witnesses (position, time), oldest first; where the last break was; open obligations
        self.seen, self.broken, self.open = json.loads(told) if told else ([], 0, [])

    def told(self) -> str:
        return json.dumps([self.seen, self.broken, self.open])

    def passed(self, time: int, at: int | None) -> Iterator[tuple]:
        """Closes the windows that lie before a time."""
        if self.rule.high is not None:
            late = [o for o in self.open if o[1] + self.rule.high < time]
            self.open = [o for o in self.open if o[1] + self.rule.high >= time]
            yield from ((pos, self.rule.denies, at) for pos, _ in late)

    def step(self, pos: int, time: int, parts: set[int]) -> Iterator[tuple]:
        """One position's facts."""
        rule = self.rule
        yield from self.passed(time, pos)
        if rule.future:
            if GUARD in parts:
                self.open.append((pos, time))
            if WITNESS in parts:
                hit = [o for o in self.open if time - o[1] >= rule.low]
                self.open = [o for o in self.open if time - o[1] < rule.low]
                yield from ((p, not rule.denies, pos) for p, _ in hit)
            if BREAK in parts:
                yield from ((p, False, pos) for p, _ in self.open)
                self.open = []
            return
        if BREAK in parts:
            self.broken = pos
        if WITNESS in parts:
            self.seen.append((pos, time))
        # of those that are old enough, only the newest can matter now or later
        old = sum(t <= time - rule.low for _, t in self.seen)
        self.seen = self.seen[max(0, old - 1) :]
        if GUARD in parts:
            found = bool(old) and self.seen[0][0] >= self.broken and (rule.high is None or time - self.seen[0][1] <= rule.high)
            yield pos, found != rule.denies, pos


def verdicts(monitor: Monitor, name: str, facts: DataFrame) -> DataFrame:
    """key (JSON of the guard's arguments), pos, holds, determined_at of each binding of the guard, as a stream.

    facts: a stream of pos, ts (seconds, 0 at least), pred and args, in order of position but
    within a micro-batch; the facts of one position come in one. determined_at is the position of the binding's own event that told the verdict,
    null where the watermark did. Rows with a null position, time or predicate are left out.
    """
    rule, parts, key = plan(monitor, name)
    rows = F.lit(None).cast("struct<key:string,part:int>")
    options = []
    for p, part in parts:
        names = [t.name for t in p.args]
        mine = (F.col("pred") == p.name) & (F.size("args") == len(names))
        args = F.to_json(F.array(*(F.get("args", F.lit(names.index(v))) for v in key))) if key else F.lit("[]")
        options.append(F.when(mine, F.struct(args.alias("key"), F.lit(part).alias("part"))).otherwise(rows))
    options.append(F.when(F.col("pred") == END, F.struct(F.lit("").alias("key"), F.lit(-1).alias("part"))).otherwise(rows))
    known = facts.where("pos is not null and ts is not null and pred is not null")
    flat = known.select("pos", "ts", F.explode(F.array_compact(F.array(*options))).alias("x")).select("pos", "ts", F.timestamp_seconds(F.col("ts") + SHIFT).alias("time"), "x.*")

    def act(name_of, batches, state):
        import pandas as pd

        binding = Binding(rule, state.get[0] if state.exists else None)
        out: list[tuple] = []
        if state.hasTimedOut:
            out += binding.passed(state.getCurrentWatermarkMs() // 1000 - SHIFT + 1, None)
        else:
            got: dict[int, tuple[int, set[int]]] = {}
            for table in batches:
                for pos, ts, part in zip(table["pos"].tolist(), table["ts"].tolist(), table["part"].tolist(), strict=True):
                    got.setdefault(pos, (ts, set()))[1].add(part)
            for pos in sorted(got):
                out += binding.step(pos, *got[pos])
        state.update((binding.told(),))
        if binding.open and rule.high is not None:
            due = (min(t for _, t in binding.open) + rule.high + SHIFT) * 1000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if out:
            pos, holds, at = zip(*out, strict=True)
            yield pd.DataFrame({"key": [name_of[0]] * len(pos), "pos": pd.array(pos, "Int64"), "holds": list(holds), "determined_at": pd.array(at, "Int64")})

    return flat.withWatermark("time", "1 second").groupBy("key").applyInPandasWithState(act, OUT, "told string", "append", "EventTimeTimeout")
