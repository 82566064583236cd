"""Relations over bindings and position ranges.

A relation holds rows (bindings..., f, t): for that binding, every position from f to t. Its
size follows the facts, not the positions; ranges of one binding may overlap unless `flat`
says that they are maximal and apart. Time is read through an Axis. All operations are joins,
aggregations and linear window scans, keyed by bindings; a long scan, with or without a key, is
done in two levels (within ranges of the axis, then over one summary row a range and key).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.storage import checkpointed

#: Rows of a scan without a key in one range, about; up to so many positions it is not cut.
RANGE_ROWS = 1_000_000
#: Ranges of positions at least, where they are the key of a join.
CUTS = 64
#: Ranges at most, and fine cuts for each, from which ranges of even size are put together.
MOST_RANGES, FINE = 20_000, 64
#: With more positions a scan with a key is cut, too, so that a key with a third of all rows is many tasks' work.
HOT_ROWS = 16_000_000


class Axis:
    """Positions 1..n with their times; mirrored, both run backwards."""

    def __init__(self, positions: DataFrame, n: int, first: int | None, last: int | None, back: Axis | None = None):
        self.positions, self.n, self.first, self.last = positions, n, first, last
        self._back = back

    @cached_property
    def mirrored(self) -> Axis:
        if self._back is not None:
            return self._back
        turned = self.positions.select((F.lit(self.n + 1) - F.col("pos")).alias("pos"), (-F.col("ts")).alias("ts"))
        neg = lambda x: None if x is None else -x
        return Axis(turned, self.n, neg(self.last), neg(self.first), self)

    def timed(self) -> None:
        if self.first is None and self.n:
            raise ValueError("a time bound needs a trace with timestamps")

    def at(self, df: DataFrame, pos: str, out: str) -> DataFrame:
        """df with the time of a position; null outside 1..n."""
        times = self.positions.select(F.col("pos").alias("_pos"), F.col("ts").alias(out))
        return df.join(times, F.col(pos) == F.col("_pos"), "left").drop("_pos")

    @cached_property
    def _times(self) -> DataFrame:
        return self.positions.groupBy("ts").agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))

    def _lookup(self, df: DataFrame, when: Column, out: str, after: bool) -> DataFrame:
        asked = df.withColumn("_q", when).withColumn("_k", F.lit(0))
        axis = self._times.select(F.col("ts").alias("_q"), F.lit(1).alias("_k"), F.col("_lo" if after else "_hi").alias("_p"))
        both = asked.unionByName(axis, allowMissingColumns=True)
        found = running(both, [], "_q", F.col("_k").desc(), (self.first or 0, self.last or 0), {out: ("min" if after else "max", F.col("_p"), True)}, down=after, n=self.n)
        return found.where("_k = 0").drop("_q", "_k", "_p").withColumn(out, F.coalesce(out, F.lit(self.n + 1 if after else 0).cast("long")))

    def first_from(self, df: DataFrame, when: Column, out: str) -> DataFrame:
        """df with the first position at a time or later; n + 1 if none."""
        return self._lookup(df, when, out, True)

    def last_until(self, df: DataFrame, when: Column, out: str) -> DataFrame:
        """df with the last position up to a time; 0 if none."""
        return self._lookup(df, when, out, False)


def running(df: DataFrame, keys: list[str], by: str, tie: Column, span: tuple[int, int], out: dict[str, tuple[str, Column, bool]], down: bool = False, n: int | None = None) -> DataFrame:
    """df with running minima or maxima in the order of `by`, then tie.

    out: name -> (min or max, values, whether the row itself counts). span: least and largest
    value of `by`, about. down: from the largest on. n: positions of the axis, where `by` is none.
    """
    order = [F.col(by).desc() if down else F.col(by).asc(), tie]
    fold = {"min": (F.min, F.least), "max": (F.max, F.greatest)}
    n = span[1] - span[0] + 1 if n is None else n

    def frame(window, own):
        return window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)

    if n <= (HOT_ROWS if keys else RANGE_ROWS):
        window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        return df.select("*", *(fold[fn][0](x).over(frame(window, own)).alias(name) for name, (fn, x, own) in out.items()))
    ranges = min(MOST_RANGES, -(-n // RANGE_ROWS))
    df = checkpointed(df)  # it is read two or three times below, and so would be all before it
    df = ranged(df, by, span, ranges) if keys else even_ranges(df, by, span, ranges)
    local = df.select("*", *(fold[fn][0](x).over(frame(Window.partitionBy(*keys, "_b"), own)).alias(name) for name, (fn, x, own) in out.items()))
    summary = df.groupBy(*keys, "_b").agg(*(fold[fn][0](x).alias(f"_s_{name}") for name, (fn, x, _) in out.items()))
    before = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = before.orderBy(F.col("_b").desc() if down else F.col("_b").asc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*(F.col(k).alias(f"_c_{k}") for k in keys), F.col("_b").alias("_c"), *(fold[fn][0](f"_s_{name}").over(before).alias(f"_s_{name}") for name, (fn, _, _) in out.items()))
    # without a key, MOST_RANGES and a few rows are broadcast at most
    joined = local.join(carry if keys else F.broadcast(carry), [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys] + [F.col("_b") == F.col("_c")])
    for name, (fn, _, _) in out.items():
        joined = joined.withColumn(name, fold[fn][1](name, f"_s_{name}"))
    return joined.drop("_b", "_c", *(f"_c_{k}" for k in keys), *(f"_s_{name}" for name in out))


def ranged(df: DataFrame, by: str, span: tuple[int, int], ranges: int, out: str = "_b") -> DataFrame:
    """df with the number of the range of `by`, of so many of even width, that a row lies in."""
    width = max(1, -(-(span[1] - span[0] + 1) // ranges))
    return df.withColumn(out, F.greatest(F.lit(-1), F.least(F.lit(ranges + 1), F.floor((F.col(by) - span[0]) / width).cast("int"))))


def even_ranges(df: DataFrame, by: str, span: tuple[int, int], ranges: int) -> DataFrame:
    """df with the number of a range of `by` with about RANGE_ROWS rows (more where a fine cut alone has more): a busy hour makes many."""
    cut = ranged(df, by, span, ranges * FINE, "_f")
    upto = F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("_f").rowsBetween(Window.unboundedPreceding, -1))
    sizes = cut.groupBy("_f").count()
    # one row a fine cut, FINE * MOST_RANGES and a few at most
    names = sizes.select(F.col("_f").alias("_g"), F.floor(F.coalesce(upto, F.lit(0)) / RANGE_ROWS).cast("int").alias("_b"))
    return cut.join(F.broadcast(names), F.col("_f") == F.col("_g")).drop("_f", "_g")


@dataclass(frozen=True)
class Rel:
    """vars: bound variables, each a column v_<name>; points: every range is one position; flat: ranges of a binding are maximal.

    lasting: every range runs on to the last position.
    """

    vars: tuple[str, ...]
    df: DataFrame
    points: bool = False
    flat: bool = False
    lasting: bool = False

    @property
    def keys(self) -> list[str]:
        return [col(v) for v in self.vars]

    @property
    def stamp(self) -> list[str]:
        """The column s with each point's time, where the rows carry it; else nothing."""
        return ["s"] if self.points and "s" in self.df.columns else []


def col(var: str) -> str:
    return f"v_{var}"


def cols(names) -> list[str]:
    return [col(v) for v in names]


def whole(axis: Axis, first: int = 1, last: int | None = None) -> Rel:
    """No variables; the positions from first to last."""
    last = axis.n if last is None else last
    spark = axis.positions.sparkSession
    return Rel((), spark.range(1 if first <= last else 0).select(F.lit(first).cast("long").alias("f"), F.lit(last).cast("long").alias("t")), flat=True)


def everywhere(axis: Axis) -> Rel:
    """No variables; every position as a point, with its time."""
    return Rel((), axis.positions.select(F.col("pos").alias("f"), F.col("pos").alias("t"), F.col("ts").alias("s")), True)


def runs(rel: Rel, axis: Axis) -> Rel:
    """The same relation with maximal ranges."""
    if rel.flat:
        return rel
    keys = rel.keys
    told = running(rel.df, keys, "f", F.col("t").asc(), (1, axis.n), {"_m": ("max", F.col("t"), False)})
    begin = F.when(F.col("_m").isNull() | (F.col("f") > F.col("_m") + 1), F.col("f"))
    told = running(told.withColumn("_s", begin), keys, "f", F.col("t").asc(), (1, axis.n), {"_i": ("max", F.col("_s"), True)})
    return Rel(rel.vars, told.groupBy(*keys, "_i").agg(F.max("t").alias("t")).select(*keys, F.col("_i").alias("f"), "t"), flat=True)


def mirror(rel: Rel, axis: Axis) -> Rel:
    end = F.lit(axis.n + 1)
    return replace(rel, lasting=False, df=rel.df.select(*rel.keys, (end - F.col("t")).alias("f"), (end - F.col("f")).alias("t")))


def union(a: Rel, b: Rel) -> Rel:
    keep = [*a.keys, "f", "t", *(a.stamp if b.stamp else [])]
    return Rel(a.vars, a.df.select(*keep).unionAll(b.df.select(*keep)), a.points and b.points)


def project(rel: Rel, keep: tuple[str, ...]) -> Rel:
    if set(keep) == set(rel.vars):
        return rel
    return Rel(keep, rel.df.select(*cols(keep), "f", "t", *rel.stamp).distinct(), rel.points, lasting=rel.lasting)


def bindings(rel: Rel, names: tuple[str, ...]) -> DataFrame:
    return rel.df.select(*cols(names)).distinct()


def clip(rel: Rel, first: int, last: int) -> Rel:
    if rel.points:
        return replace(rel, df=rel.df.where(F.col("f").between(first, last)))
    df = rel.df.select(*rel.keys, F.greatest("f", F.lit(first).cast("long")).alias("f"), F.least("t", F.lit(last).cast("long")).alias("t"))
    return replace(rel, df=df.where("f <= t"))


def shift(rel: Rel, axis: Axis) -> Rel:
    """One position later, within the trace."""
    df = rel.df.select(*rel.keys, (F.col("f") + 1).alias("f"), (F.col("t") + 1).alias("t"))
    return clip(replace(rel, df=df), 1, axis.n)


def _asking(rel: Rel) -> list[str]:
    return [*rel.keys, "f", "t", *rel.stamp]


def _under(guard: Rel, rel: Rel, axis: Axis) -> DataFrame:
    """A point relation's rows with _m, the end of the farthest range of rel that begins up to there; rel's variables are among the guard's."""
    ask = guard.df.select(*_asking(guard), F.col("f").alias("_o"), F.lit(1).alias("_k"))
    tell = rel.df.select(*rel.keys, F.col("f").alias("_o"), F.lit(0).alias("_k"), F.col("t").alias("_e"))
    both = ask.unionByName(tell, allowMissingColumns=True)
    return running(both, rel.keys, "_o", F.col("_k").asc(), (1, axis.n), {"_m": ("max", F.col("_e"), True)}).where("_k = 1").drop("_o", "_k", "_e")


def overlap(a: Rel, b: Rel, axis: Axis) -> Rel:
    """Where both hold: a natural join on the shared variables, ranges cut to each other."""
    names = (*a.vars, *(v for v in b.vars if v not in a.vars))
    shared = [v for v in a.vars if v in b.vars]
    if a.points and not b.points and set(b.vars) <= set(a.vars):
        return replace(a, df=_under(a, b, axis).where("_m >= f").drop("_m"), flat=False)
    if b.points and not a.points and set(a.vars) <= set(b.vars):
        got = overlap(b, a, axis)
        return Rel(names, got.df.select(*cols(names), "f", "t", *got.stamp), True)
    if a.points and b.points:
        return Rel(names, a.df.drop("t").join(b.df.drop("t", "s"), [*cols(shared), "f"]).select(*cols(names), "f", F.col("f").alias("t"), *a.stamp), True)
    left, right = a.df, b.df.withColumnsRenamed({"f": "_f", "t": "_t"} | {col(v): f"_{col(v)}" for v in shared})
    on = [F.col(col(v)) == F.col(f"_{col(v)}") for v in shared] + [F.col("f") <= F.col("_t"), F.col("_f") <= F.col("t")]
    if not shared:
        # without a shared variable, ranges of positions are the key
        width = -(-(axis.n + 1) // max(CUTS, axis.n // RANGE_ROWS))
        cut = lambda x: F.floor(F.col(x) / width).cast("int")
        left = left.withColumn("_b", F.explode(F.sequence(cut("f"), cut("t"))))
        right = right.withColumn("_c", F.explode(F.sequence(cut("_f"), cut("_t"))))
        on += [F.col("_b") == F.col("_c"), F.col("_b") == cut_max(cut("f"), cut("_f"))]
    got = left.join(right, on).select(*(F.col(col(v)) for v in names), F.greatest("f", "_f").alias("f"), F.least("t", "_t").alias("t"))
    return Rel(names, got, a.points or b.points)


def cut_max(a: Column, b: Column) -> Column:
    """The range in which an overlap begins: there alone a pair is kept."""
    return F.greatest(a, b)


def gaps(rel: Rel, owners: DataFrame, axis: Axis) -> Rel:
    """For each binding of rel's variables among the owners, the ranges where rel doesn't hold."""
    flat = runs(rel, axis).df.select(*rel.keys, "f", "t")
    edge = owners.select(*rel.keys, F.lit(0).cast("long").alias("f"), F.lit(0).cast("long").alias("t"))
    told = running(flat.unionByName(edge), rel.keys, "f", F.col("t").asc(), (0, axis.n), {"_n": ("min", F.col("f"), False)}, down=True)
    df = told.select(*rel.keys, (F.col("t") + 1).alias("f"), F.coalesce(F.col("_n") - 1, F.lit(axis.n)).alias("t")).where("f <= t")
    if rel.vars:
        df = df.join(owners.select(*(F.col(c).alias(f"_{c}") for c in rel.keys)).distinct(), [F.col(c) == F.col(f"_{c}") for c in rel.keys], "left_semi")
    return Rel(rel.vars, df, flat=True)


def subtract(a: Rel, b: Rel, axis: Axis) -> Rel:
    """Where a holds and b doesn't; b's variables are among a's."""
    if a.points:
        return replace(a, df=_under(a, b, axis).where("_m is null or _m < f").drop("_m"), flat=False)
    owners = bindings(a, b.vars) if b.vars else axis.positions.sparkSession.range(1).select()
    return replace(overlap(a, gaps(b, owners, axis), axis), vars=a.vars, flat=False)


def once(rel: Rel, axis: Axis) -> Rel:
    df = rel.df.groupBy(*rel.keys).agg(F.min("f").alias("f"))
    return Rel(rel.vars, df.where("f is not null").select(*rel.keys, "f", F.lit(axis.n).cast("long").alias("t")), flat=True, lasting=True)


def from_start(rel: Rel, axis: Axis) -> Rel:
    """The first range of each binding, where it begins at position 1."""
    return replace(runs(rel, axis), df=runs(rel, axis).df.where("f = 1"))


@dataclass(frozen=True)
class Witness:
    """What a time-bounded operator asks at a position: a witness low to high time units before (future: after), unbroken since.

    points: the witnesses. low, high: an int, None (high) or a column of whoever asks. strict:
    not at the position itself. breaks: where what must hold behind the witness up to now does not.
    """

    points: Rel
    low: int | str
    high: int | str | None
    future: bool
    strict: bool = False
    breaks: Rel | None = None


def _stamped(rel: Rel, axis: Axis, needed: bool) -> DataFrame:
    """A point relation's rows with their times in s, or with nulls there where no time is needed."""
    if not needed:
        return rel.df if rel.stamp else rel.df.withColumn("s", F.lit(None).cast("long"))
    axis.timed()
    return rel.df if rel.stamp else axis.at(rel.df, "f", "s")


def newest(guard: Rel, asked: Witness, axis: Axis, times: bool = False) -> DataFrame:
    """The guard's rows with their place and time _o, _s, and _w, _ws of the newest witness that is old enough; _e: where the last break so far ends.

    Places and times are negative where the future is asked; without a bound, times are null
    unless they are asked for. One scan a key finds all.
    """
    sign = -1 if asked.future else 1
    mine, breaks = asked.points, asked.breaks
    needed = times or asked.low != 0 or asked.high is not None
    now, then = (_stamped(rel, axis, needed) for rel in (guard, mine))
    ask = now.select(*guard.df.columns, (F.col("f") * sign).alias("_o"), (F.col("s") * sign).alias("_s"), F.lit(2).alias("_k"))
    tell = then.select(*mine.keys, (F.col("f") * sign).alias("_o"), (F.col("s") * sign).alias("_s"), F.lit(3 if asked.strict else 1).alias("_k"))
    told = F.col("_k") != 2
    places = (1, axis.n) if sign > 0 else (-axis.n, -1)
    span = (axis.first or 0, axis.last or 0) if sign > 0 else (-(axis.last or 0), -(axis.first or 0))
    witness = told & (F.col("_k") > 0)
    found = {"_w": ("max", F.when(witness, F.col("_o")), True), "_ws": ("max", F.when(witness, F.col("_s")), True)}
    last = {"_e": ("max", F.when(F.col("_k") == 0, F.col("_end")), True)}
    together = breaks is not None and breaks.keys == mine.keys
    both = ask.unionByName(tell, allowMissingColumns=True)
    if breaks is not None:
        ends = ("f", "t") if sign > 0 else ("t", "f")
        broken = breaks.df.select(*breaks.keys, (F.col(ends[0]) * sign).alias("_o"), (F.col(ends[1]) * sign).alias("_end"), F.lit(0).alias("_k"))
        if together:
            both = both.unionByName(broken, allowMissingColumns=True)
    if isinstance(asked.low, int) and asked.low == 0:
        both = running(both, mine.keys, "_o", F.col("_k").asc(), places, found | (last if together else {}))
    else:
        low = F.lit(asked.low) if isinstance(asked.low, int) else F.col(asked.low)
        both = both.withColumn("_q", F.when(told, F.col("_s")).otherwise(F.col("_s") - low))
        # nothing at the same time as what is asked for counts as later, but with a bound of 0 what lies behind
        tie = F.struct(F.when(~told & (low > 0), F.lit(2**62)).otherwise(F.col("_o")).alias("a"), F.col("_k").alias("b"))
        both = running(both, mine.keys, "_q", tie.asc(), span, found, n=axis.n).drop("_q")
        if together:
            both = running(both, mine.keys, "_o", F.col("_k").asc(), places, last)
    got = both.where(~told)
    if breaks is not None and not together:
        got = running(got.unionByName(broken, allowMissingColumns=True), breaks.keys, "_o", F.col("_k").asc(), places, last).where(~told)
    return got.drop("_k", "_end") if breaks is not None else got.drop("_k").withColumn("_e", F.lit(None).cast("long"))


def unbroken(asked: Witness) -> Column:
    """Whether a row of newest() has a witness within the upper bound and no break since."""
    yes = F.col("_w").isNotNull() & (F.col("_e").isNull() | (F.least("_e", "_o") <= F.col("_w")))
    if asked.high is not None:
        yes &= F.col("_s") - F.col("_ws") <= (F.lit(asked.high) if isinstance(asked.high, int) else F.col(asked.high))
    return F.coalesce(yes, F.lit(False))


def within(guard: Rel, asked: Witness, axis: Axis, fails: bool = False) -> Rel:
    """The points of the guard where the question is answered by yes (fails: by no); its variables are among the guard's.

    The newest witness that is old enough decides: older ones are farther off and broken no less.
    """
    yes = unbroken(asked)
    got = newest(guard, asked, axis).where(~yes if fails else yes)
    return replace(guard, df=got.select(*guard.df.columns), flat=False, lasting=False)


def oldest(guard: Rel, asked: Witness, axis: Axis) -> DataFrame:
    """As newest(), but _w and _ws are of the oldest witness within the upper bound and behind the last break; null if there is none. low is 0."""
    got = newest(guard, replace(asked, low=0), axis, times=True).drop("_w", "_ws")
    sign = -1 if asked.future else 1
    mine = asked.points
    then = mine.df if mine.stamp else axis.at(mine.df, "f", "s")
    tell = then.select(*mine.keys, (F.col("f") * sign).alias("_o"), (F.col("s") * sign).alias("_s"), F.lit(0).alias("_k"))
    far = (axis.last or 0) - (axis.first or 0) + 1
    high = F.lit(far if asked.high is None else asked.high)
    places, times = ((1, axis.n), (axis.first or 0, axis.last or 0)) if sign > 0 else ((-axis.n, -1), (-(axis.last or 0), -(axis.first or 0)))
    ask = got.withColumn("_k", F.lit(1)).withColumn("_from", F.when(F.col("_e").isNotNull(), F.least("_e", "_o")).otherwise(F.lit(places[0]).cast("long")))
    both = ask.unionByName(tell, allowMissingColumns=True)
    told = F.col("_k") == 0
    first = {"1": ("min", F.when(told, F.col("_o")), True), "2": ("min", F.when(told, F.col("_s")), True)}

    def found(df: DataFrame, by: Column, name: str, span: tuple[int, int]) -> DataFrame:
        df = df.withColumn("_q", by)
        return running(df, mine.keys, "_q", F.col("_k").asc(), span, {f"_{name}{k}": x for k, x in first.items()}, down=True, n=axis.n).drop("_q")

    both = found(both, F.when(told, F.col("_s")).otherwise(F.col("_s") - high), "a", times)
    both = found(both, F.when(told, F.col("_o")).otherwise(F.col("_from")), "b", places)
    # the later of the first one young enough and the first one behind the break
    w, ws = F.when(F.col("_a1").isNotNull() & F.col("_b1").isNotNull(), F.greatest("_a1", "_b1")), F.greatest("_a2", "_b2")
    both = both.where(~told).withColumn("_w", w).withColumn("_ws", ws)
    good = F.col("_w") <= F.col("_o")
    return both.withColumn("_w", F.when(good, F.col("_w"))).withColumn("_ws", F.when(good, F.col("_ws"))).drop("_k", "_from", "_a1", "_a2", "_b1", "_b2")


def best_before(guard: Rel, rel: Rel, value: str, most: bool, axis: Axis, out: str) -> DataFrame:
    """The guard's rows with the largest (or least) value of a variable among the lasting ranges begun by then, by rel's other variables."""
    keys = [k for k in rel.keys if k != value]
    ask = guard.df.withColumn("_o", F.col("f")).withColumn("_k", F.lit(1))
    tell = rel.df.select(*keys, F.col("f").alias("_o"), F.lit(0).alias("_k"), F.col(value).alias("_x"))
    both = ask.unionByName(tell, allowMissingColumns=True)
    return running(both, keys, "_o", F.col("_k").asc(), (1, axis.n), {out: ("max" if most else "min", F.col("_x"), True)}).where("_k = 1").drop("_o", "_k", "_x")


def since_unbroken(w: Rel, breaks: Rel, axis: Axis) -> Rel:
    """Ranges of w stretched up to the next break; the breaks' variables are among w's."""
    ask = w.df.select(*w.keys, "f", "t", F.col("t").alias("_o"), F.lit(1).alias("_k"))
    tell = breaks.df.select(*breaks.keys, F.col("f").alias("_o"), F.lit(0).alias("_k"), F.col("f").alias("_rf"), F.col("t").alias("_rt"))
    both = ask.unionByName(tell, allowMissingColumns=True)
    told = running(both, breaks.keys, "_o", F.col("_k").asc(), (1, axis.n), {"_m": ("max", F.col("_rt"), True)})
    # later breaks only: at one position, w's own row comes before them on the way down
    told = running(told, breaks.keys, "_o", F.col("_k").desc(), (1, axis.n), {"_n": ("min", F.col("_rf"), False)}, down=True).where("_k = 1")
    later = F.when(F.col("_n") > F.col("t"), F.col("_n") - 1)
    end = F.when(F.col("_m") > F.col("t"), F.col("t")).otherwise(F.coalesce(later, F.lit(axis.n)))
    return Rel(w.vars, told.select(*w.keys, "f", end.cast("long").alias("t")))


def since_held(w: Rel, holds: Rel, axis: Axis) -> Rel:
    """Ranges of w stretched to the end of the run that goes on from them; the runs' variables are among w's."""
    held = runs(holds, axis)
    ask = w.df.select(*w.keys, "f", "t", (F.col("t") + 1).alias("_o"), F.lit(1).alias("_k"))
    tell = held.df.select(*held.keys, F.col("f").alias("_o"), F.lit(0).alias("_k"), F.col("t").alias("_rt"))
    both = ask.unionByName(tell, allowMissingColumns=True)
    told = running(both, held.keys, "_o", F.col("_k").asc(), (1, axis.n + 1), {"_m": ("max", F.col("_rt"), True)}).where("_k = 1")
    return Rel(w.vars, told.select(*w.keys, "f", F.greatest("t", "_m").alias("t")))


def spread_points(rel: Rel) -> Rel:
    """One row a position."""
    if rel.points:
        return rel
    df = rel.df.withColumn("_p", F.explode(F.sequence("f", "t"))).drop("f", "t").withColumn("f", F.col("_p")).withColumnRenamed("_p", "t")
    return Rel(rel.vars, df, True)


def reachable(a: int, b: int | None, axis: Axis) -> Rel:
    """Positions with any position at a to b time units before."""
    df = axis.positions.select("pos", "ts")
    df = axis.last_until(df, F.col("ts") - a, "_h").withColumn("_h", F.least("_h", "pos")).where("_h >= 1")
    if b is not None:
        df = axis.at(df, "_h", "_th").where(F.col("_th") >= F.col("ts") - b)
    return Rel((), df.select(F.col("pos").alias("f"), F.col("pos").alias("t")), True)


def _first_after(df: DataFrame, pos: str, low, out: str, axis: Axis) -> DataFrame:
    """First position at `low` time units or more after a position, and not before it."""
    if isinstance(low, int) and low == 0:
        return df.withColumn(out, F.col(pos))
    df = axis.first_from(axis.at(df, pos, "_ta"), F.col("_ta") + low, out).drop("_ta")
    return df.withColumn(out, F.greatest(out, pos))


def _last_within(df: DataFrame, pos: str, high, out: str, axis: Axis) -> DataFrame:
    """Last position at most `high` time units after a position; n without a bound."""
    if high is None:
        return df.withColumn(out, F.lit(axis.n).cast("long"))
    return axis.last_until(axis.at(df, pos, "_tb"), F.col("_tb") + high, out).drop("_tb")


def timed_once(rel: Rel, low, high, axis: Axis, strict: bool = False) -> Rel:
    """Positions at low to high time units after one where rel holds (strict: after that position; for points only). Bounds are ints, None (high) or columns of rel."""
    axis.timed()
    if not isinstance(low, int) or not (high is None or isinstance(high, int)):
        rel = spread_points(rel)
    elif not rel.points:
        rel = runs(rel, axis)
    df = _first_after(rel.df, "f", low, "_a", axis)
    if strict:
        df = df.withColumn("_a", F.greatest("_a", F.col("f") + 1))
    df = _last_within(df, "t", high, "_e", axis).where("_a <= _e")
    out = Rel(rel.vars, df.select(*rel.keys, F.col("_a").alias("f"), F.col("_e").alias("t")))
    if not rel.points and low != 0:
        kept = Rel(rel.vars, out.df)
        out = overlap(kept, runs(reachable(low, high, axis), axis), axis)
    return out


def timed_all_covered(rel: Rel, low, high, axis: Axis) -> Rel:
    """Positions whose whole (low, high) past lies in a range of rel; positions without such a past may be among them."""
    axis.timed()
    flat = runs(rel, axis)
    df = flat.df.withColumn("_before", F.col("f") - 1).withColumn("_after", F.col("t") + 1)
    if high is None:
        df = df.where("f = 1").withColumn("_a", F.lit(0).cast("long"))
    else:
        df = _last_within(df, "_before", high, "_a", axis).withColumn("_a", F.when(F.col("_before") < 1, F.lit(0)).otherwise(F.col("_a")))
    df = _first_after(df, "_after", low, "_e", axis).withColumn("_e", F.when(F.col("_after") > axis.n, F.lit(axis.n + 1)).otherwise(F.col("_e")))
    df = df.select(*flat.keys, (F.col("_a") + 1).cast("long").alias("f"), (F.col("_e") - 1).cast("long").alias("t")).where("f <= t")
    return Rel(rel.vars, df)


def _within_runs(w: Rel, held: Rel, low, high, axis: Axis, strict: bool) -> Rel:
    """w at low to high time units before, in the same run of held or just before it."""
    axis.timed()
    names = (*w.vars, "_rf", "_rt")
    run = runs(held, axis).df.select(*held.keys, F.greatest(F.col("f") - 1, F.lit(1)).alias("f"), "t", F.col("f").alias(col("_rf")), F.col("t").alias(col("_rt")))
    met = overlap(Rel(w.vars, w.df, w.points), Rel((*held.vars, "_rf", "_rt"), run), axis)
    inside = Rel(names, met.df.select(*cols(names), "f", "t"), w.points, True)
    reach = timed_once(inside, low, high, axis, strict)
    return Rel(w.vars, reach.df.select(*w.keys, F.greatest("f", col("_rf")).alias("f"), F.least("t", col("_rt")).alias("t")).where("f <= t"))


def timed_since(w: Rel, held: Rel, low, high, axis: Axis) -> Rel:
    """w at low to high time units before, and held from behind it to now; held's variables are among w's."""
    out = _within_runs(w if w.points else runs(w, axis), held, low, high, axis, False)
    if isinstance(low, int):
        return union(out, w) if low == 0 else out
    own = spread_points(w)
    return union(out, Rel(w.vars, own.df.where(low == 0), True))


def timed_zince(w: Rel, held: Rel, low, high, axis: Axis) -> Rel:
    """As timed_since, with w strictly before; w is points."""
    return _within_runs(w, held, low, high, axis, True)
