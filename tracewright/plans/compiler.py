"""Formulas to relations.

A subformula's value is a boolean combination of finite relations and of constraints on data
(comparisons, patterns, functions), which stay as they are until a relation binds their
variables. A relation under a negation stays a relation, so a formula that is false for all
but finitely many bindings costs no more than one that is true for finitely many. Quantifiers
range over infinite sorts: what all but finitely many values satisfy, some value satisfies.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.patterns import decompose, segments, whole_regex
from tracewright.functions.pyfuncs import PyFunction
from tracewright.operators import relation as R
from tracewright.operators.relation import Axis, Rel, col, cols
from tracewright.plans.formula import Arith, Call, Compare, Const, Logic, Matches, Not, Pred, Quant, Temporal, Truth, Var, free_vars, show, term_vars, terms, walk
from tracewright.sources.trace import Trace, typed

#: Results of a Python function or pattern that a worker keeps.
KEPT = 1 << 14
SPARK = {"String": T.StringType(), "Int": T.LongType(), "Real": T.DoubleType(), "Bool": T.BooleanType()}


def kept(make):
    """The function that make() gives; pure, so a worker keeps what it has computed."""
    loaded: dict = {}

    def run(*values):
        if "f" not in loaded:
            loaded["f"] = lru_cache(KEPT)(make())
        return loaded["f"](*values)

    return run


class NotMonitorable(ValueError):
    """The property constrains values that no fact binds."""


@dataclass(frozen=True)
class Lit:
    rel: Rel


class Within(Lit):
    """A time-bounded operator on witnesses that are points: asked at a guard's points by one scan, or made a relation if need be."""

    def __init__(self, asked: R.Witness, ends: tuple[str, ...], make):
        object.__setattr__(self, "asked", asked)
        object.__setattr__(self, "vars", {*asked.points.vars, *ends})
        object.__setattr__(self, "make", make)

    @cached_property
    def rel(self) -> Rel:
        return self.make()


@dataclass(frozen=True)
class Test:
    """A constraint on data: a Compare, a Matches, or a Pred that is a Python function."""

    atom: object


@dataclass(frozen=True)
class Neg:
    value: object


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


TRUE, FALSE = All(()), Any(())


def variables(v) -> set[str]:
    if isinstance(v, Lit):
        return set(v.vars if isinstance(v, Within) else v.rel.vars)
    if isinstance(v, Test):
        return free_vars(v.atom)
    if isinstance(v, Neg):
        return variables(v.value)
    return set().union(set(), *(variables(p) for p in v.parts))


def negated(v):
    """The negation, pushed to relations and tests."""
    if isinstance(v, Neg):
        return v.value
    if isinstance(v, All):
        return any_of([negated(p) for p in v.parts])
    if isinstance(v, Any):
        return all_of([negated(p) for p in v.parts])
    return Neg(v)


def all_of(parts: list):
    flat = []
    for p in parts:
        if p == FALSE:
            return FALSE
        flat += p.parts if isinstance(p, All) else (p,)
    return flat[0] if len(flat) == 1 else All(tuple(flat))


def any_of(parts: list):
    flat = []
    for p in parts:
        if p == TRUE:
            return TRUE
        flat += p.parts if isinstance(p, Any) else (p,)
    return flat[0] if len(flat) == 1 else Any(tuple(flat))


class Compiler:
    """Compiles one property's formula, with variables of their own names, on a trace."""

    def __init__(self, formula, trace: Trace, sorts: dict[str, str], preds: dict, functions: dict[str, PyFunction], names: dict[str, str]):
        self.formula, self.trace, self.axis, self.preds, self.functions = formula, trace, trace.axis, preds, functions
        self.sorts = {v: sorts.get(names.get(v, v), "String") for v in {*names, *sorts, *names.values()}} | {v: s for v, s in sorts.items() if v not in names}
        self.nodes: dict = {}

    # --- terms and constraints

    def term(self, t) -> Column:
        if isinstance(t, Const):
            return F.lit(t.value)
        if isinstance(t, Var):
            return F.col(col(t.name))
        if isinstance(t, Arith):
            a, b = self.term(t.left), self.term(t.right)
            return {"+": a + b, "-": a - b, "*": a * b}[t.op]
        return self.call(t.name, t.args)

    def call(self, name: str, args: tuple) -> Column:
        fn = self.functions[name]
        run = kept(fn.callable)
        given = [self.term(a).cast(SPARK[s]) for a, s in zip(args, fn.args, strict=True)]
        return F.udf(run, SPARK[fn.result], useArrow=True)(*given)

    def holds(self, atom) -> Column:
        """The constraint as a condition, all its variables being bound."""
        if isinstance(atom, Compare):
            a, b = self.term(atom.left), self.term(atom.right)
            return F.contains(a, b) if atom.op == "contains" else {"=": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[atom.op]
        if isinstance(atom, Matches):
            simple = self.plain_match(atom)
            if simple is not None:
                return simple
            parts, holes = segments(atom.pattern, atom.slashed), [h for h, _ in atom.holes]

            def fits(subject, *given):
                return bool(decompose(parts, subject, dict(zip(holes, given, strict=True))))

            return F.udf(kept(lambda: fits), T.BooleanType(), useArrow=True)(self.term(atom.subject), *(self.term(t) for _, t in atom.holes))
        return self.call(atom.name, atom.args)

    def plain_match(self, atom) -> Column | None:
        """A pattern without holes, by built-in string tests."""
        parts = segments(atom.pattern, atom.slashed)
        s = self.term(atom.subject)
        texts = [p[1] for p in parts if p[0] == "text"]
        if len(texts) == 1 and len(parts) <= 3 and all(p[0] == "text" or p == ("gap", None) for p in parts):
            before, after = parts[0][0] == "gap", parts[-1][0] == "gap"
            test = {(True, True): F.contains, (True, False): F.endswith, (False, True): F.startswith}.get((before, after))
            return test(s, F.lit(texts[0])) if test else s == texts[0]
        regex = whole_regex(parts)
        return None if regex is None else s.rlike(regex)

    def binds(self, atom, known: set[str]) -> bool:
        """Whether the constraint gives its unbound variables their values."""
        if isinstance(atom, Matches):
            return term_vars(atom.subject) <= known
        return self._defined(atom, known) is not None

    def _defined(self, atom, known: set[str]):
        if isinstance(atom, Compare) and atom.op == "=":
            for x, t in ((atom.left, atom.right), (atom.right, atom.left)):
                if isinstance(x, Var) and x.name not in known and term_vars(t) <= known:
                    return x.name, t
        return None

    def extend(self, guard: Rel, atom) -> Rel:
        """guard with the variables that a constraint binds."""
        known = set(guard.vars)
        if not isinstance(atom, Matches):
            name, t = self._defined(atom, known)
            df = guard.df.withColumn(col(name), self.term(t).cast(SPARK[self.sorts.get(name, "String")]) if self.sorts.get(name) != "Real" else self.term(t))
            return Rel((*guard.vars, name), df, guard.points)
        parts, holes = segments(atom.pattern, atom.slashed), list(atom.holes)
        bound = [h for h, t in holes if term_vars(t) <= known]
        new = [(h, t) for h, t in holes if h not in bound]

        def every(subject, *given):
            fixed = dict(zip(bound, given, strict=True))
            return [[d[h] for h, _ in new] for d in decompose(parts, subject, fixed)]

        call = F.udf(kept(lambda: every), T.ArrayType(T.ArrayType(T.StringType())), useArrow=True)
        df = guard.df.withColumn("_d", F.explode(call(self.term(atom.subject), *(self.term(t) for h, t in holes if h in bound))))
        for k, (_, t) in enumerate(new):
            df = df.withColumn(col(t.name), F.get("_d", F.lit(k)))
        return Rel((*guard.vars, *(t.name for _, t in new)), df.drop("_d").distinct(), guard.points)

    # --- domains

    def domain(self, var: str, given: dict[str, DataFrame]) -> DataFrame:
        """Values that stand for all values of a variable: a guard's, or those of the trace and some that it lacks."""
        if var in given:
            return given[var]
        sort = self.sorts.get(var, "String")
        spark = self.trace.spark
        if sort == "Bool":
            return spark.createDataFrame([(True,), (False,)], f"{col(var)} boolean")
        for node in walk(self.formula):
            mine = set().union(set(), *(term_vars(t) for t in terms(node)))
            plain = isinstance(node, Pred) and node.name not in self.functions or isinstance(node, Compare) and node.op == "=" and all(isinstance(t, (Var, Const)) for t in terms(node))
            if var in mine and not plain or isinstance(node, Temporal) and node.bound and var in (node.bound.low, node.bound.high):
                raise NotMonitorable(f"variable {var.split('__')[0]} is constrained in {show(node)}, but no fact binds it there")
        parts, constants = [], []
        for node in walk(self.formula):
            if isinstance(node, Pred) and node.name not in self.functions:
                sorts = self.arg_sorts(node)
                for k, s in enumerate(sorts):
                    if s == sort:
                        parts.append(self.trace.relation(node.name, len(sorts), sorts).select(F.col(f"a{k}").alias(col(var))))
            constants += [t.value for t in terms(node) if isinstance(t, Const) and t.sort == sort]
        fresh = sum(1 for n in walk(self.formula) if isinstance(n, Quant) and self.sorts.get(n.var) == sort) + 1
        kind = {"String": "string", "Int": "long", "Real": "double"}[sort]
        extra = [f"\x00{k}" for k in range(fresh)] if sort == "String" else [-(2**62) + k for k in range(fresh)] if sort == "Int" else [-(2.0**900) * (k + 1) for k in range(fresh)]
        parts.append(spark.createDataFrame([(x,) for x in [*constants, *extra]], f"{col(var)} {kind}"))
        return reduce(lambda a, b: a.unionAll(b), parts).distinct()

    def expand(self, rel: Rel, names: list[str], given: dict) -> Rel:
        """rel for every value of further variables."""
        for v in names:
            rel = Rel((*rel.vars, v), rel.df.crossJoin(self.domain(v, given)), rel.points)
        return rel

    # --- finite relations

    def finite(self, v, given: dict, loose: bool = False) -> Rel | None:
        """The relation of a value that holds for finitely many bindings only; loose: over the domains if need be."""
        if isinstance(v, Lit):
            return v.rel
        if isinstance(v, Any):
            names = variables(v)
            parts = []
            for p in v.parts:
                rel = self.finite(p, given, loose)
                lack = sorted(names - set(rel.vars)) if rel is not None else []
                if rel is None or lack and not (loose or set(lack) <= set(given)):
                    return None
                parts.append(self.expand(rel, lack, given))
            if not parts:
                return Rel((), self.trace.spark.createDataFrame([], "f long, t long"), True)
            return reduce(R.union, parts)
        if isinstance(v, All):
            if v.parts and all(isinstance(q, Within) and not variables(q) for q in (p.value if isinstance(p, Neg) else p for p in v.parts)):
                return self.restrict(R.everywhere(self.axis), v, given, loose)  # asked at every position
            guards = [p for p in v.parts if isinstance(p, Lit) and not isinstance(p, Within)] or [p for p in v.parts if isinstance(p, Lit)]
            rest = [p for p in v.parts if not any(p is g for g in guards)]
            if not guards:
                for p in rest:
                    rel = self.finite(p, given) if isinstance(p, Any) and p.parts else None
                    if rel is not None:
                        guards, rest = [Lit(rel)], [x for x in rest if x is not p]
                        break
            if guards:
                points = sorted(guards, key=lambda g: (not g.rel.points, -len(g.rel.vars)))
                rel = points[0].rel
                for g in self.connected(rel, points[1:]):
                    rel = R.overlap(rel, g.rel, self.axis)
                return self.restrict(rel, All(tuple(rest)), given, loose)
        names = sorted(variables(v))
        if all(x in given for x in names) or loose:
            return self.restrict(self.expand(R.whole(self.axis), names, given), v, given, loose)
        return None

    @staticmethod
    def connected(rel: Rel, others: list) -> list:
        """The others, such that each shares a variable with those before it if any does."""
        known, out, left = set(rel.vars), [], list(others)
        while left:
            pick = next((g for g in left if known & set(g.rel.vars)), left[0])
            left.remove(pick)
            known |= set(pick.rel.vars)
            out.append(pick)
        return out

    def restrict(self, guard: Rel, v, given: dict, loose: bool = False) -> Rel | None:
        """Where both the guard and the value hold; None if a variable stays unbound."""
        if isinstance(v, Within) and guard.points and variables(v) <= set(guard.vars):
            return R.within(guard, v.asked, self.axis)
        if isinstance(v, Lit):
            return R.overlap(guard, v.rel, self.axis)
        if isinstance(v, All):
            left = list(v.parts)
            while left:
                known = set(guard.vars)
                pick = next((p for p in left if isinstance(p, (Lit, Test, Neg)) and variables(p) <= known), None)
                pick = pick or next((p for p in left if isinstance(p, Lit)), None)
                pick = pick or next((p for p in left if isinstance(p, Test) and self.binds(p.atom, known)), None)
                pick = pick or next((p for p in left if variables(p) <= known), None) or left[0]
                left.remove(pick)
                guard = self.restrict(guard, pick, given, loose)
                if guard is None:
                    return None
            return guard
        if isinstance(v, Any) and not v.parts:
            return Rel(guard.vars, guard.df.where(F.lit(False)), guard.points)
        if isinstance(v, Test) and not variables(v) <= set(guard.vars) and self.binds(v.atom, set(guard.vars)):
            return self.extend(guard, v.atom)
        lack = sorted(variables(v) - set(guard.vars))
        if lack:
            finite = self.finite(v, given) if isinstance(v, Any) else None
            if finite is not None:
                return R.overlap(guard, finite, self.axis)
            if not (loose or set(lack) <= set(given)):
                return None
            guard = self.expand(guard, lack, given)
        if isinstance(v, Any):
            parts = [self.restrict(guard, p, given, loose) for p in v.parts]
            return None if any(p is None for p in parts) else reduce(R.union, parts)
        if isinstance(v, Test):
            return Rel(guard.vars, guard.df.where(self.holds(v.atom)), guard.points, guard.flat)
        if isinstance(v.value, Within) and guard.points:
            return R.within(guard, v.value.asked, self.axis, fails=True)
        if isinstance(v.value, Lit):
            return R.subtract(guard, v.value.rel, self.axis)
        return Rel(guard.vars, guard.df.where(~self.holds(v.value.atom)), guard.points, guard.flat)

    def form(self, v, given: dict) -> tuple[bool, Rel]:
        """(True, relation) of a finite value, or (False, relation) of one that is false for finitely many bindings."""
        for known in ({}, given):  # values of a guard only where nothing else is finite
            rel = self.finite(v, known)
            if rel is not None:
                return True, rel
            rel = self.finite(negated(v), known)
            if rel is not None:
                return False, rel
        return True, self.finite(v, given, loose=True)

    # --- quantifiers

    def exists(self, v, x: str, given: dict):
        if x not in variables(v):
            return v
        if isinstance(v, Any):
            return any_of([self.exists(p, x, given) for p in v.parts])
        if isinstance(v, All):
            own = [p for p in v.parts if x in variables(p)]
            rest = [p for p in v.parts if x not in variables(p)]
            if len(own) == 1 and not isinstance(own[0], Any) or any(isinstance(p, Lit) and x in variables(p) for p in own):
                inner = self._exists(own, rest, x, given)
                if inner is not None:
                    return inner
            choice = next((p for p in own if isinstance(p, Any)), None)
            if choice is not None:
                others = [p for p in own if p is not choice]
                return all_of([*rest, any_of([self.exists(all_of([q, *others]), x, given) for q in choice.parts])])
            return self._exists(own, rest, x, given) or self._loose(own, rest, x, given)
        return self._exists([v], [], x, given) or self._loose([v], [], x, given)

    def foldable(self, own: list, rest: list, x: str):
        """The lasting relation, the comparison and the guard of `some x that began by now compares with the guard's value`, if that is what own says."""
        lasting = next((p for p in own if isinstance(p, Lit) and not isinstance(p, Within) and p.rel.lasting and x in p.rel.vars), None)
        test = next((p for p in own if isinstance(p, Test) or isinstance(p, Neg) and isinstance(p.value, Test)), None)
        if lasting is None or test is None or len(own) != 2 or self.sorts.get(x) not in ("Int", "Real"):
            return None
        atom = test.value.atom if isinstance(test, Neg) else test.atom
        if not isinstance(atom, Compare) or atom.op not in ("<", "<=", ">", ">="):
            return None
        sides = [t for t in (atom.left, atom.right) if isinstance(t, Var) and t.name == x]
        others = term_vars(atom.left) | term_vars(atom.right)
        if len(sides) != 1 or x in term_vars(atom.right if atom.left is sides[0] else atom.left):
            return None
        asked = (set(lasting.rel.vars) | others) - {x}
        guard = next((p for p in rest if isinstance(p, Lit) and not isinstance(p, Within) and p.rel.points and asked <= set(p.rel.vars)), None)
        return None if guard is None else (lasting, test, guard)

    def fold(self, found: tuple, rest: list, x: str):
        """Only the largest or least x can matter: one scan instead of all pairs."""
        lasting, test, guard = found
        atom = test.value.atom if isinstance(test, Neg) else test.atom
        left = isinstance(atom.left, Var) and atom.left.name == x
        more = (atom.op in (">", ">=")) == left
        if isinstance(test, Neg):
            more = not more
        df = R.best_before(guard.rel, lasting.rel, col(x), more, self.axis, col(x)).where(F.col(col(x)).isNotNull())
        holds = self.holds(atom)
        df = df.where(~holds if isinstance(test, Neg) else holds).drop(col(x))
        return all_of([*(p for p in rest if p is not guard), Lit(Rel(guard.rel.vars, df, True))])

    def _exists(self, own: list, rest: list, x: str, given: dict):
        found = self.foldable(own, rest, x)
        if found is not None:
            return self.fold(found, rest, x)
        if all(isinstance(p, Neg) and isinstance(p.value, Lit) for p in own) and self.sorts.get(x) != "Bool":
            return all_of(rest)  # all but finitely many values satisfy them
        # what binds the other variables may stand beside the quantifier
        beside = [p for p in rest if isinstance(p, Lit)]
        for known, guards in (({}, []), ({}, beside), (given, []), (given, beside)):
            rel = self.finite(all_of([*own, *guards]), known)
            if rel is not None and x in rel.vars:
                out = Lit(R.project(rel, tuple(n for n in rel.vars if n != x)))
                return all_of([*(p for p in rest if not any(p is g for g in guards)), out])
        if all(isinstance(p, Neg) and isinstance(p.value, Lit) for p in own):
            return None
        tests = [p for p in own if isinstance(p, Test)]
        if len(own) == len(tests) == 1 and isinstance(tests[0].atom, Compare) and self.trivially(tests[0].atom, x):
            return all_of(rest)
        return None

    def trivially(self, atom, x: str) -> bool:
        """Whether some value of x satisfies a single comparison whatever the other terms are."""
        sides = [t for t in (atom.left, atom.right) if x in term_vars(t)]
        return len(sides) == 1 and isinstance(sides[0], Var) and (atom.op == "=" or atom.op in ("<", "<=", ">", ">=") and self.sorts.get(x) in ("Int", "Real"))

    def _loose(self, own: list, rest: list, x: str, given: dict):
        v = all_of(own)
        rel = self.finite(v, given, loose=True)
        return all_of([*rest, Lit(R.project(rel, tuple(n for n in rel.vars if n != x)))])

    # --- formulas

    def arg_sorts(self, f: Pred) -> list[str]:
        declared = self.preds.get(f.name, ())
        if len(declared) == len(f.args):
            return [s for _, s in declared]
        return [t.sort if isinstance(t, Const) else self.sorts.get(t.name, "String") for t in f.args]

    def facts(self, f: Pred) -> Rel:
        sorts = self.arg_sorts(f)
        df = self.trace.relation(f.name, len(f.args), sorts)
        taken: dict[str, str] = {}
        for k, (t, s) in enumerate(zip(f.args, sorts, strict=True)):
            a = F.col(f"a{k}")
            if isinstance(t, Const):
                df = df.where(a == (typed(F.lit(str(t.value)), s) if s != "Real" else F.lit(t.value)))
            elif t.name in taken:
                df = df.where(a == F.col(taken[t.name]))
            else:
                taken[t.name] = f"a{k}"
        names = tuple(taken)
        stamp = [F.col("ts").alias("s")] if "ts" in df.columns else []
        return Rel(names, df.select(*(F.col(taken[v]).alias(col(v)) for v in names), F.col("pos").alias("f"), F.col("pos").alias("t"), *stamp), True)

    def guarded(self, v, given: dict) -> dict[str, DataFrame]:
        """given, with the values that a finite value's bindings have."""
        rel = (self.finite(v, {}) or self.finite(v, given)) if variables(v) else None
        if rel is None:
            return given
        return given | {x: rel.df.select(col(x)).distinct() for x in rel.vars if x not in given}

    def evaluate(self, f, given: dict):
        got = self._evaluate(f, given)
        self.nodes[id(f)] = (f, got)
        return got

    def _evaluate(self, f, given: dict):
        if isinstance(f, Truth):
            return TRUE if f.value else FALSE
        if isinstance(f, Pred):
            return Test(f) if f.name in self.functions else Lit(self.facts(f))
        if isinstance(f, (Compare, Matches)):
            return Test(f)
        if isinstance(f, Not):
            return negated(self.evaluate(f.body, given))
        if isinstance(f, Quant):
            block = [f]
            while isinstance(block[-1].body, Quant) and block[-1].body.kind == f.kind:
                block.append(block[-1].body)
            first = self.folded(block, given) if len(block) > 1 else None
            if first is not None:
                return first
            inner = self.evaluate(f.body, given)
            if f.kind == "Exists":
                return self.exists(inner, f.var, given)
            return negated(self.exists(negated(inner), f.var, given))
        if isinstance(f, Logic):
            if f.op == "<->":
                a, b = self.evaluate(f.left, given), self.evaluate(f.right, given)
                return all_of([any_of([negated(a), b]), any_of([negated(b), a])])
            if f.op == "&":
                return self.conjunction(f, given)
            a = self.evaluate(f.left, given)
            if f.op == "->":
                return any_of([negated(a), self.evaluate(f.right, self.guarded(a, given) if self.asks(f.right) else given)])
            return any_of([a, self.evaluate(f.right, given)])
        return self.temporal(f, given)

    def folded(self, block: list[Quant], given: dict):
        """The value of quantifiers of one kind, which may change places, if one of them before the last can be folded first."""
        value = self.evaluate(block[-1].body, given)
        value = value if block[-1].kind == "Exists" else negated(value)
        names = [q.var for q in reversed(block)]
        if not isinstance(value, All):
            return None
        for x in names[1:]:
            own, rest = [p for p in value.parts if x in variables(p)], [p for p in value.parts if x not in variables(p)]
            found = self.foldable(own, rest, x)
            if found is not None:
                value = self.fold(found, rest, x)
                for y in names:
                    value = value if y == x else self.exists(value, y, given)
                return value if block[-1].kind == "Exists" else negated(value)
        return None

    def asks(self, f) -> bool:
        """Whether values of outer variables may be needed inside: for bounds from data, or for constraints and negations under a temporal operator."""
        if isinstance(f, (Compare, Matches)):
            return False
        return any(isinstance(n, (Compare, Matches)) or isinstance(n, Pred) and n.name in self.functions or isinstance(n, Temporal) and n.bound and (isinstance(n.bound.low, str) or isinstance(n.bound.high, str)) for n in walk(f))

    def conjunction(self, f, given: dict):
        parts, stack = [], [f]
        while stack:
            n = stack.pop()
            if isinstance(n, Logic) and n.op == "&":
                stack += [n.right, n.left]
            else:
                parts.append(n)
        values: dict[int, object] = {}
        asking = [k for k, p in enumerate(parts) if self.asks(p)]
        for k, p in enumerate(parts):
            if k not in asking:
                values[k] = self.evaluate(p, given)
        if asking and values:
            given = self.guarded(all_of(list(values.values())), given)
        for k in asking:
            values[k] = self.evaluate(parts[k], given)
        return all_of([values[k] for k in range(len(parts))])

    # --- temporal operators; future ones on the mirrored axis

    def temporal(self, f: Temporal, given: dict):
        op, future = f.op, f.op in "XFGU"
        axis = self.axis.mirrored if future else self.axis
        if op in "HG":
            return negated(self.past("P", TRUE, negated(self.evaluate(f.right, given)), f.bound, axis, future, given))
        if op == "I":
            return self.past("S", negated(self.evaluate(f.right, given)), self.evaluate(f.left, given), None, axis, future, given)
        right = self.evaluate(f.right, given)
        left = TRUE if f.left is None else self.evaluate(f.left, given)
        if op == "Z" and f.bound is None:

            def stepwise():
                return all_of([left, self.past("@", TRUE, self.past("S", left, right, None, axis, False, given), None, axis, False, given)])

            asked = self.lazy(left, right, None, True, False, given, [], lambda: self.finite(stepwise(), given))
            return stepwise() if asked is None else asked
        return self.past({"X": "@", "F": "P", "U": "S"}.get(op, op), left, right, f.bound, axis, future, given)

    def past(self, op: str, left, right, bound, axis: Axis, future: bool, given: dict):
        turn = (lambda r: R.mirror(r, axis)) if future else (lambda r: r)

        def form(v):
            finite, rel = self.form(v, given)
            return finite, turn(rel)

        def flip(v):
            if isinstance(v, Within):
                return v
            if isinstance(v, Lit):
                return Lit(turn(v.rel))
            if isinstance(v, Neg):
                return Neg(flip(v.value))
            return v if isinstance(v, Test) else type(v)(tuple(flip(p) for p in v.parts))

        if op == "@":
            finite, rel = form(right)
            moved = Lit(R.shift(rel, axis))
            return flip(moved if finite else all_of([Lit(R.whole(axis, 2)), Neg(moved)]))
        low, high = (0, None) if bound is None else (bound.low, bound.high)
        strict = op == "Z"
        ends = [x for x in (low, high) if isinstance(x, str)]
        low, high = (F.col(col(x)) if isinstance(x, str) else x for x in (low, high))
        timed = bound is not None and not (future and bound.low == 0 and bound.high is None)
        finite, plain = self.form(right, given)
        w = turn(plain)
        lack = [x for x in ends if x not in w.vars]
        if timed or left != TRUE:

            def make():
                far = self.expand(w, lack, given) if lack else w
                got = self.once(True, far, low, high, timed, axis) if left == TRUE and not strict else self.since(left, far, low, high, timed, strict, axis, form)
                return flip(got).rel

            asked = self.lazy(left, right, bound, strict, future, given, lack, make)
            if asked is not None:
                return asked
        if lack:
            w = self.expand(w, lack, given)
        if left == TRUE and not strict:
            return flip(self.once(finite, w, low, high, timed, axis))
        if not finite:
            owners = R.bindings(w, w.vars)
            field = Rel(w.vars, owners.crossJoin(R.whole(axis).df), flat=True)
            inside = self.since(left, R.gaps(w, owners, axis), low, high, timed, strict, axis, form)
            outside = self.since(left, R.whole(axis), low, high, timed, strict, axis, form) if timed or strict or ends else TRUE
            return flip(any_of([all_of([Neg(Lit(field)), outside]), inside]))
        return flip(self.since(left, w, low, high, timed, strict, axis, form))

    def lazy(self, left, right, bound, strict: bool, future: bool, given: dict, lack: list, make):
        """The operator as a question to a guard's points, where its witnesses are points and its breaks have no further variables."""
        finite, points = self.form(right, given)
        if not (finite and points.points and all(x in given for x in lack)):
            return None
        breaks = None if left == TRUE else self.form(left, given)
        if breaks is not None and (breaks[0] or not set(breaks[1].vars) <= set(points.vars)):
            return None
        low, high = (0, None) if bound is None else (col(x) if isinstance(x, str) else x for x in (bound.low, bound.high))
        return Within(R.Witness(points, low, high, future, strict, None if breaks is None else breaks[1]), tuple(lack), make)

    def once(self, finite: bool, w: Rel, low, high, timed: bool, axis: Axis):
        if not timed:
            return Lit(R.once(w, axis)) if finite else Neg(Lit(R.from_start(w, axis)))
        if finite:
            return Lit(R.timed_once(w, low, high, axis))
        if not isinstance(low, int):
            raise NotMonitorable("a lower bound from data needs a witness that facts bind")
        out = Neg(Lit(R.timed_all_covered(w, low, high, axis)))
        return out if low == 0 else all_of([Lit(R.reachable(low, high, axis)), out]) if high is None or isinstance(high, int) else self._no_cover()

    def _no_cover(self):
        raise NotMonitorable("a bound from data with a lower bound over 0 needs a witness that facts bind")

    def since(self, left, w: Rel, low, high, timed: bool, strict: bool, axis: Axis, form):
        if left == TRUE:
            held_finite, held = False, Rel((), R.whole(axis, 1, 0).df, flat=True)
        else:
            held_finite, held = form(left)
        extra = [v for v in held.vars if v not in w.vars]
        if not extra:
            return Lit(self._since(w, held_finite, held, low, high, timed, strict, axis))
        # the run's further variables: the bindings that it names are worked apart from all others
        shared = [v for v in w.vars if v in held.vars]
        pairs = R.bindings(held, held.vars)
        w2_df = w.df.join(pairs, cols(shared)) if shared else w.df.crossJoin(pairs)
        w2 = Rel((*w.vars, *extra), w2_df.select(*cols((*w.vars, *extra)), "f", "t"), w.points)
        inner = self._since(w2, held_finite, held, low, high, timed, strict, axis)
        if held_finite:
            now = [] if strict or not (isinstance(low, int) and low == 0) else [Lit(w)]
            return any_of([*now, Lit(inner)])
        base = self._since(w, False, Rel((), R.whole(axis, 1, 0).df, flat=True), low, high, timed, strict, axis)
        base2_df = base.df.join(pairs, cols(shared)) if shared else base.df.crossJoin(pairs)
        base2 = Rel(w2.vars, base2_df.select(*w2.keys, "f", "t"), base.points)
        return all_of([Lit(base), Neg(Lit(R.subtract(base2, inner, axis)))])

    def _since(self, w: Rel, held_finite: bool, held: Rel, low, high, timed: bool, strict: bool, axis: Axis) -> Rel:
        if not timed and not strict:
            return R.since_held(w, held, axis) if held_finite else R.since_unbroken(w, held, axis)
        run = held if held_finite else R.gaps(held, R.bindings(w, held.vars) if held.vars else self.trace.spark.range(1).select(), axis)
        if strict:
            return R.timed_zince(R.spread_points(w), run, low, high, axis)
        return R.timed_since(w, run, low, high, axis)

