"""Specifications on traces: verdicts, trace tables, parametric regions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.pyfuncs import load_functions
from tracewright.operators import relation as R
from tracewright.plans import analysis
from tracewright.plans.compiler import All, Any, Compiler, Lit, NotMonitorable, Within, negated, variables
from tracewright.plans.formula import Quant, Spec
from tracewright.plans.parser import SpecError, parse_spec
from tracewright.sources.trace import Trace

VERDICTS = "pos long, property string, holds boolean, determined_at long"


class Monitor:
    """A specification; each property becomes a DataFrame plan on a trace."""

    def __init__(self, spec: Spec | str):
        self.spec = parse_spec(spec) if isinstance(spec, str) else spec
        self.functions = load_functions(self.spec.python)
        for name in self.functions:
            if name in self.spec.preds or name in self.spec.macros:
                raise SpecError(f"{name} is a function and a predicate")
        self.formulas, self.sorts, self.names, self.params = {}, {}, {}, {}
        for name, p in self.spec.properties.items():
            flat = analysis.expand_macros(p.formula, self.spec.macros)
            self.params[name] = analysis.check_parameters(flat)
            self.sorts[name] = analysis.infer_sorts(flat, self.spec.preds, self.functions)
            self.formulas[name], self.names[name] = analysis.unique_vars(flat)

    @cached_property
    def timed(self) -> bool:
        return any(analysis.is_timed(f) for f in self.formulas.values())

    def compiler(self, name: str, trace: Trace) -> Compiler:
        return Compiler(self.formulas[name], trace, self.sorts[name], self.spec.preds, self.functions, self.names[name])

    def violated(self, name: str, trace: Trace, first_only: bool | None = None) -> R.Rel:
        """Position ranges where a property without parameters fails."""
        if self.params[name]:
            raise SpecError(f"property {name} has parameters: ask for its constraints")
        if self.timed:
            trace.axis.timed()
        compiler = self.compiler(name, trace)
        value = negated(compiler.evaluate(self.formulas[name], {}))
        for x in sorted(variables(value)):  # an open property holds if some value satisfies it
            value = negated(compiler.exists(negated(value), x, {}))
        anchored = self.spec.properties[name].anchored if first_only is None else first_only
        rel = compiler.finite(at_first(value) if anchored else value, {}, loose=True)
        if rel is None:
            raise NotMonitorable(f"property {name} has a variable that no fact binds")
        return R.clip(rel, 1, 1) if anchored else rel

    def violations(self, name: str, trace: Trace) -> DataFrame:
        """pos of each violation, once."""
        rel = self.violated(name, trace)
        return R.spread_points(R.runs(rel, trace.axis) if not rel.points else rel).df.select(F.col("f").alias("pos")).distinct()

    def verdicts(self, name: str, trace: Trace) -> DataFrame:
        """pos, property, holds, determined_at: one row a position (for an anchored property, position 1).

        determined_at is the position itself for a property of the past. With future operators it
        is the position at which the verdict is known (null: at the end of the trace); where
        delays.py does not cover the property's shape, it is null throughout.
        """
        if analysis.has_future(self.formulas[name]):
            from tracewright.plans.delays import delayed

            try:
                got = delayed(self, name, trace)
            except NotMonitorable:
                pass
            else:
                return got.select("pos", F.lit(name).alias("property"), "holds", "determined_at")
        anchored = self.spec.properties[name].anchored
        bad = self.violations(name, trace).withColumnRenamed("pos", "_bad")
        positions = trace.positions.select("pos")
        positions = positions.where("pos = 1") if anchored else positions
        future = analysis.has_future(self.formulas[name])
        known = F.lit(None).cast("long") if future else F.col("pos")
        return positions.join(bad, F.col("pos") == F.col("_bad"), "left").select("pos", F.lit(name).alias("property"), F.col("_bad").isNull().alias("holds"), known.alias("determined_at"))

    def run(self, trace: Trace) -> DataFrame:
        """The verdicts of all properties without parameters."""
        out = None
        for name in self.spec.properties:
            if not self.params[name]:
                got = self.verdicts(name, trace)
                out = got if out is None else out.unionByName(got)
        return trace.spark.createDataFrame([], VERDICTS) if out is None else out


def at_first(value):
    """A value whose guards' points are cut to position 1, before anything is asked at them."""
    if isinstance(value, (All, Any)):
        return type(value)(tuple(at_first(p) for p in value.parts))
    return Lit(R.clip(value.rel, 1, 1)) if isinstance(value, Lit) and not isinstance(value, Within) and value.rel.points else value


def quantified(f) -> tuple[list[Quant], object]:
    """The leading quantifiers, and what they stand before."""
    outer = []
    while isinstance(f, Quant):
        outer.append(f)
        f = f.body
    return outer, f
