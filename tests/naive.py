"""Formulas by their definitions: every position, every value of a finite domain."""


from tracewright.functions.patterns import decompose, segments
from tracewright.plans.formula import Call, Compare, Const, Logic, Matches, Not, Pred, Quant, Temporal, Truth, Var


class Naive:
    """events: (facts, time) in order, facts a dict of predicate -> argument tuples; domains: values for each sort."""

    def __init__(self, events, domains, sorts, functions=None):
        self.events, self.domains, self.sorts, self.functions = events, domains, sorts, functions or {}
        self.n, self.memo = len(events), {}

    def term(self, t, env):
        if isinstance(t, Const):
            return t.value
        if isinstance(t, Var):
            return env[t.name]
        if isinstance(t, Call):
            return self.functions[t.name](*(self.term(a, env) for a in t.args))
        a, b = self.term(t.left, env), self.term(t.right, env)
        return a + b if t.op == "+" else a - b if t.op == "-" else a * b

    def holds(self, f, i, env=None):
        env = env or {}
        key = (id(f), i, tuple(sorted(env.items())))
        if key not in self.memo:
            self.memo[key] = self._holds(f, i, env)
        return self.memo[key]

    def _holds(self, f, i, env):
        if isinstance(f, Truth):
            return f.value
        if isinstance(f, Pred):
            if f.name in self.functions:
                return self.functions[f.name](*(self.term(t, env) for t in f.args))
            want = tuple(self.term(t, env) for t in f.args)
            return want in self.events[i - 1][0].get(f.name, [])
        if isinstance(f, Compare):
            a, b = self.term(f.left, env), self.term(f.right, env)
            return {"=": lambda: a == b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "contains": lambda: b in a}[f.op]()
        if isinstance(f, Matches):
            given = {h: self.term(t, env) for h, t in f.holes}
            return bool(decompose(segments(f.pattern, f.slashed), self.term(f.subject, env), given))
        if isinstance(f, Not):
            return not self.holds(f.body, i, env)
        if isinstance(f, Logic):
            a = self.holds(f.left, i, env)
            if f.op == "&":
                return a and self.holds(f.right, i, env)
            if f.op == "|":
                return a or self.holds(f.right, i, env)
            b = self.holds(f.right, i, env)
            return (not a or b) if f.op == "->" else a == b
        if isinstance(f, Quant):
            fold = any if f.kind == "Exists" else all
            return fold(self.holds(f.body, i, env | {f.var: v}) for v in self.domains[self.sorts[f.var]])
        return self._temporal(f, i, env)

    def _temporal(self, f, i, env):
        """From the positions where the right side holds, and those where the left one fails."""
        here, op = self.events[i - 1][1], f.op
        if op in "@X":
            j = i - 1 if op == "@" else i + 1
            return 1 <= j <= self.n and self.holds(f.right, j, env)
        if op == "I":
            starts = [j for j in range(1, i + 1) if self.holds(f.left, j, env)]
            return bool(starts) and not any(self.holds(f.right, k, env) for k in range(starts[-1] + 1, i + 1))
        reach = range(i, self.n + 1) if op in "FGU" else range(1, i) if op == "Z" else range(1, i + 1)
        if f.bound is not None:
            low, high = (env[x] if isinstance(x, str) else x for x in (f.bound.low, f.bound.high))
            delay = {j: abs(here - self.events[j - 1][1]) for j in reach}
            reach = [j for j in reach if low <= delay[j] and (high is None or delay[j] <= high)]
        if op in "HG":
            return not [j for j in reach if not self.holds(f.right, j, env)]
        found = [j for j in reach if self.holds(f.right, j, env)]
        if op in "PF" or not found:
            return bool(found)
        # the witness nearest to now has the least between it and now
        j = found[0] if op == "U" else found[-1]
        between = range(i, j) if op == "U" else range(j + 1, i + 1)
        return not [k for k in between if not self.holds(f.left, k, env)]


def verdicts(formula, events, domains, sorts, functions=None):
    naive = Naive(events, domains, sorts, functions)
    return [naive.holds(formula, i) for i in range(1, len(events) + 1)]


def random_events(rng, preds, values, most=9):
    out, ts = [], 0
    for _ in range(rng.randint(1, most)):
        facts = {}
        for _ in range(rng.randint(0, 2)):
            name, arity = rng.choice(preds)
            facts.setdefault(name, set()).add(tuple(rng.choice(values) for _ in range(arity)))
        out.append(({k: sorted(v) for k, v in facts.items()}, ts))
        ts += rng.choice([0, 0, 1, 1, 2, 3])
    return out


