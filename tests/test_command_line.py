"""The command line's sinks on a small log."""

from tracewright.__main__ import main, run
from tracewright.plans.monitor import Monitor
from tracewright.plans.tree import tree_rows
from tracewright.sources.trace import trace_of_text

LOG = "open,a,0\n\nclose,a,3\nopen,b,4\nclose,b,12\n"
TIMELY = "prop timely : Forall f . close(f) -> P[<=5] open(f)\n"
WITHIN = "prop within : Forall f . close(f) -> P[<=n] open(f)\n"


def said(spark, tmp_path, spec, **more):
    log = tmp_path / "log.csv"
    log.write_text(LOG)
    lines = []
    return run(spark, spec, str(log), say=lines.append, **more), lines


def test_violations(spark, tmp_path):
    count, lines = said(spark, tmp_path, TIMELY)
    assert count == 1
    assert lines[1:] == ["*** Violation of timely at event 4: close(b) @ 12", "Processed 4 events, 1 violation(s)."]


def test_trace_table_and_parameters(spark, tmp_path):
    count, lines = said(spark, tmp_path, TIMELY + WITHIN, trace_too=True)
    assert count == 1
    assert [x.split("  ")[-1].strip() for x in lines[2:6]] == ["within: holds", "within: holds iff 3 <= n", "within: holds", "within: holds iff 8 <= n"]
    assert "timely: VIOLATED" in lines[5] and "close(b) @ 12" in lines[5]
    assert lines[6:] == ["Parametric verdict for within: holds iff 8 <= n", "Processed 4 events, 1 violation(s)."]


def test_tree(spark):
    trace = trace_of_text(spark, LOG, timed=True)
    rows = [(r.pos, r.depth, r.value) for r in tree_rows(Monitor(TIMELY), "timely", trace).orderBy("pos", "node").collect()]
    assert [v for p, d, v in rows if d == 0] == ["true", "true", "true", "false"]
    assert (2, 2, "f=a") in rows and (4, 2, "f=b") in rows


def test_usage(capsys):
    assert main(["only-one"]) == 2
    assert capsys.readouterr().out.startswith("usage:")
