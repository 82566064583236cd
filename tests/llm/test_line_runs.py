"""Runs of line hashes: batches, compaction, a second session's batch, and joins without an exchange."""

import random
import re
from collections import defaultdict

from tests.llm import brute
from tracewright.llm.line_dedup import LineRuns, batches_for, line_dedup


def rows_of(runs):
    return {bytes(r.h): (r.n_docs, r.keeper) for r in runs.counts().collect()}


def batch(spark, rows):
    return spark.createDataFrame([(h.encode(), d) for h, d in rows], "h binary, doc long").distinct()


def test_batches(spark, tmp_path):
    """Each line counts its documents over all batches and is kept by the batch that brought it first."""
    rng, folder = random.Random(1), str(tmp_path / "runs")
    held, keeper = defaultdict(set), {}
    runs = LineRuns(spark, folder, fanout=2, buckets=4)
    assert rows_of(runs) == {}
    for k in range(5):
        docs = range(100 * k, 100 * k + 20)
        pairs = [(f"line{rng.randrange(60)}", d) for d in docs for _ in range(5)] + [("everywhere", d) for d in docs]
        for h in {h for h, _ in pairs} - set(held):
            keeper[h.encode()] = max(d for x, d in pairs if x == h)
        for h, d in pairs:
            held[h].add(d)
        if k == 3:  # a later session opens the folder anew
            runs.close()
            runs = LineRuns(spark, folder, fanout=2, buckets=99)
            assert runs.buckets == 4
        runs.add(batch(spark, pairs))
        assert rows_of(runs) == {h.encode(): (len(d), keeper[h.encode()]) for h, d in held.items()}
    assert sorted(runs.levels.values()) == [0, 2]  # five batches at a fanout of two: one run of four, and one
    runs.close(delete=True)


def test_merge_without_exchange(spark, tmp_path):
    runs = LineRuns(spark, str(tmp_path / "runs"), fanout=9, buckets=4)
    for k in range(2):
        runs.add(batch(spark, [(f"l{i}", i + 1000 * k) for i in range(0, 300, k + 1)]))
    a, b = runs.runs()
    plan = a.hint("merge").join(b.select("h"), "h", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not re.search(r"Exchange (hash|range)", plan)
    runs.close(delete=True)


def test_rows_of_one_id(spark):
    """Rows of one id are one document; null ids are one, smaller than all; columns of the same names are replaced."""
    line = "a line that is long enough"
    rows = [(1, f"{line}\nown"), (1, f"{line}\nmine\n{line}"), (2, line.upper()), (None, f" {line} "), (None, None), (5, ""), (3, "short\nshort")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as n_lines", "'x' as h", "'y' as _row")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup(docs, min_docs=3).collect())
    assert got == sorted([(1, rows[0][1], 2, 1, "own"), (1, rows[1][1], 3, 2, "mine"), (2, rows[2][1], 1, 0, line.upper()), (-1, rows[3][1], 1, 1, ""), (-1, "", 1, 0, ""), (5, "", 1, 0, ""), (3, "short\nshort", 2, 0, "short\nshort")])


def test_numbers_of_batches(spark):
    assert [batches_for(n) for n in (0, 249_999, 250_000, 1_000_000, 10_000_000)] == [2, 2, 2, 4, 7]
    docs = [(k, "\n".join(f"this is line number {(k * i) % 17}" for i in range(6))) for k in range(40)]
    want = sorted(brute.op5(docs))
    for n in (1, 2, 7):
        out = line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), batches=n, fanout=2).collect()
        assert sorted((r.doc_id, r.n_lines, r.n_dropped, brute.sha(r.kept_text)) for r in out) == want


def noted(monkeypatch):
    """For each batch that is added from now on its plan, and the rows that the plan's joins make."""
    plans, write = [], LineRuns._write

    def noting(self, rows, level, instead_of):
        if not instead_of:
            plan = rows._jdf.queryExecution().executedPlan().toString()
            plans.append((plan, len(re.findall("Join", plan)) * rows.count()))
        write(self, rows, level, instead_of)

    monkeypatch.setattr(LineRuns, "_write", noting)
    return plans


def test_one_join_a_batch(spark, tmp_path, monkeypatch):
    """A batch is joined once, however many runs there are, and no run is exchanged; a folder that the manifest does not name is no run."""
    folder, plans = str(tmp_path / "runs"), noted(monkeypatch)
    runs = LineRuns(spark, folder, fanout=9, buckets=4)
    for k in range(4):
        runs.add(batch(spark, [(f"l{i}", i + 1000 * k) for i in range(0, 300, k + 1)]))
    assert [len(re.findall("Join", p)) for p, _ in plans] == [0, 1, 1, 1]
    assert len({len(re.findall("Exchange", p)) for p, _ in plans}) == 1  # the first has no runs
    runs.written += 1  # a session that ended before its manifest was written
    spark.sql("SELECT X'00' AS h, 1L AS n_docs, 1L AS keeper").write.parquet(f"{folder}/run-4")
    runs.add(batch(spark, [("\0", 7), ("l0", 8)]))
    got = rows_of(runs)
    assert got[b"\0"] == (1, 7) and got[b"l0"] == (5, 0) and got[b"l6"] == (3, 6) and len(got) == 301
    runs.close(delete=True)


def test_joins_grow_with_lines(spark, monkeypatch):
    """The joins of batches with runs make no more rows than there are lines, with many batches, too."""
    docs = [(k, "\n".join(f"this is line number {k} {i} of its own" for i in range(4))) for k in range(400)]
    frame, plans = spark.createDataFrame(docs, "doc_id long, text string"), noted(monkeypatch)
    for n in (2, 5, 9):
        plans.clear()
        assert line_dedup(frame, batches=n).where("n_dropped > 0").isEmpty()
        assert len(plans) == n and 0 < sum(made for _, made in plans) <= 1600
