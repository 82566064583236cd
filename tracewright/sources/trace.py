"""Traces: positions with times, and facts by predicate."""

from __future__ import annotations

import csv
from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.operators.relation import RANGE_ROWS, Axis

FACTS = "pos long, ts long, pred string, args array<string>"


def typed(value: Column, sort: str) -> Column:
    """Text as a value of a sort; malformed numbers raise."""
    return {"String": value, "Int": value.cast("long"), "Real": value.cast("decimal(38,12)"), "Bool": F.lower(value) == "true"}[sort]


class Trace:
    """positions(pos, ts) with pos = 1..n in order of time, and facts.

    A predicate comes from `tables` if it is there under (name, arity) - a DataFrame with pos
    and its arguments as a0, a1, ..., of their own types, and ts where it is at hand - else from
    facts(pos, ts, pred, args). ts may be null where no time is needed.
    """

    def __init__(self, positions: DataFrame, facts: DataFrame | None = None, tables: dict[tuple[str, int], DataFrame] | None = None):
        self.positions, self.facts, self.tables = positions.select("pos", "ts"), facts, tables or {}

    @property
    def spark(self) -> SparkSession:
        return self.positions.sparkSession

    @cached_property
    def axis(self) -> Axis:
        # one small aggregate; distinct positions 1..n have this count, ends and sum
        row = self.positions.agg(F.max("pos"), F.min("ts"), F.max("ts"), F.min("pos"), F.count(F.lit(1)), F.sum(F.col("pos").cast("decimal(38,0)"))).first()
        n = row[0] or 0
        if (row[4], row[3] or 0, int(row[5] or 0)) != (n, min(n, 1), n * (n + 1) // 2):
            raise ValueError("positions must be 1, 2, 3, ... without gaps")
        return Axis(self.positions, n, row[1], row[2])

    def check_order(self) -> None:
        """Raises if a time lies before that of an earlier position, or some positions have none."""
        n = self.axis.n
        part = F.floor(F.col("pos") / RANGE_ROWS)
        told = self.positions.select("pos", "ts", part.alias("part"))
        before = F.lag("ts").over(Window.partitionBy("part").orderBy("pos"))
        within = told.withColumn("before", before).groupBy("part").agg(
            F.max(F.col("ts") < F.col("before")).alias("bad"), F.min("ts").alias("low"), F.max("ts").alias("high"), F.count("ts").alias("timed")
        )
        # one row for each RANGE_ROWS positions
        got = within.withColumn("before", F.max("high").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
        bad, timed = got.agg(F.max(F.coalesce("bad", F.lit(False)) | F.coalesce(F.col("low") < F.col("before"), F.lit(False))), F.sum("timed")).first()
        if bad:
            raise ValueError("times must not decrease")
        if timed not in (None, 0, n):
            raise ValueError("either all positions have a time or none has")

    def relation(self, name: str, arity: int, sorts: list[str]) -> DataFrame:
        """pos, a0, a1, ... of a predicate's facts, and ts where it is at hand; the number of arguments must agree."""
        table = self.tables.get((name, arity))
        if table is not None:
            got = dict(table.dtypes)
            fix = [typed(F.col(f"a{k}"), s) if got[f"a{k}"] == "string" else F.col(f"a{k}") for k, s in enumerate(sorts)]
            return table.select("pos", *(c.alias(f"a{k}") for k, c in enumerate(fix)), *(["ts"] if "ts" in got else []))
        if self.facts is None:
            return self.spark.createDataFrame([], "pos long" + "".join(f", a{k} string" for k in range(arity))).select("pos", *(typed(F.col(f"a{k}"), s).alias(f"a{k}") for k, s in enumerate(sorts)))
        mine = self.facts.where((F.col("pred") == name) & (F.size("args") == arity))
        return mine.select("pos", *(typed(F.get("args", F.lit(k)), s).alias(f"a{k}") for k, s in enumerate(sorts)), "ts")

    @classmethod
    def from_events(cls, spark: SparkSession, events: Iterable, timed: bool | None = None) -> Trace:
        """Events in order: each a dict of predicate -> argument tuples, or (dict, time)."""
        facts, positions, latest = [], [], None
        for pos, event in enumerate(events, 1):
            event, ts = event if isinstance(event, tuple) else (event, None)
            if latest is not None and ts is not None and ts < latest:
                raise ValueError(f"the time of event {pos} lies before that of an earlier one")
            latest = ts if ts is not None else latest
            positions.append((pos, ts))
            for pred, rows in event.items():
                facts += [(pos, ts, pred, [str(a).lower() if isinstance(a, bool) else str(a) for a in row]) for row in rows]
        return cls(spark.createDataFrame(positions, "pos long, ts long").coalesce(1), spark.createDataFrame(facts, FACTS).coalesce(1))


def read_rows(lines: Iterable[str], timed: bool) -> list[tuple[str, list[str], int | None]]:
    """(predicate, arguments, time) of each line of a log; blank lines don't count, cells are trimmed."""
    out = []
    for row in csv.reader(lines):
        cells = [c.strip() for c in row]
        if not any(cells):
            continue
        ts = None
        if timed:
            try:
                ts = int(cells[-1]) if len(cells) > 1 else int("")
            except ValueError:
                raise ValueError(f"line {','.join(row)!r} has no timestamp in its last column") from None
            cells = cells[:-1]
        out.append((cells[0], cells[1:], ts))
    return out


def trace_of_text(spark: SparkSession, text: str, timed: bool = False) -> Trace:
    """A log in memory: one fact a line, one line a position."""
    return Trace.from_events(spark, [({p: [tuple(a)]}, ts) for p, a, ts in read_rows(text.splitlines(), timed)])


def read_log(spark: SparkSession, path: str, timed: bool = False) -> Trace:
    """A CSV log, a file or a folder of them: one fact a line, one line a position, the last column the time if timed.

    Files follow each other by name, lines by their place. Lines are parsed where they lie and
    counted a file split at a time; a split's first position is the sum of those before it.
    """
    import pyarrow as pa

    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), *where, "value")

    def parse(batches):
        for batch in batches:
            place, ts, pred, args = [], [], [], []
            for i, line in enumerate(batch.column(3).to_pylist()):
                for p, a, t in read_rows([line], timed):
                    place.append(i)
                    ts.append(t)
                    pred.append(p)
                    args.append(a)
            kept = batch.select([0, 1, 2]).take(pa.array(place, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(ts, pa.int64()), pa.array(pred, pa.string()), pa.array(args, pa.list_(pa.string()))], ["id", "file", "start", "ts", "pred", "args"])

    rows = lines.mapInArrow(parse, "id long, file string, start long, ts long, pred string, args array<string>")
    before = Window.partitionBy(F.lit(0)).orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # one row a file split
    count = rows.groupBy("file", "start").count()
    starts = count.select(F.col("file").alias("_file"), F.col("start").alias("_start"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("file", "start").orderBy("id"))
    facts = rows.withColumn("place", place).join(starts, (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")))
    facts = facts.select((F.col("place") + F.col("before")).alias("pos"), "ts", "pred", "args")
    trace = Trace(facts.select("pos", "ts"), facts)
    if timed:
        trace.check_order()
    return trace
