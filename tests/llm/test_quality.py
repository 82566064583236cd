"""The ordinal model's numbers by its definition, its fit, and odd tables."""

import math

import numpy as np
import pyarrow as pa

from tracewright.llm import quality as Q

GOOD = "The committee met on a quiet morning and agreed that the old bridge should be repaired before winter."
BAD = "$$$ BUY!!! now### cheap%%% CLICK*** here&&& WIN!!! $$$"


def rows_of(n):
    return [(k, f"{GOOD if k % 3 else BAD} number {k}", (0, 2, 1)[k % 3]) for k in range(n)]


def loss(w, theta, docs, grades, top):
    out = 0.0
    for slots, g in zip(docs, grades):
        score = sum(w[s] for s in slots)
        upper = 1.0 if g == top else 1 / (1 + math.exp(-(theta[g] - score)))
        lower = 0.0 if g == 0 else 1 / (1 + math.exp(-(theta[g - 1] - score)))
        out -= math.log(max(upper - lower, 1e-12))
    return out / len(docs)


def test_numbers():
    """Tails and expected grades are the cumulative link's; thresholds are in order; fitting lowers the loss of every grade's rows."""
    texts = [f"{GOOD} plain {k % 7}" if k % 2 else f"{BAD} loud {k % 5}" for k in range(200)] + ["", None, "middling text!! with some marks"] * 20
    grades = np.array([2 if k % 2 else 0 for k in range(200)] + [1] * 60)
    slots, off = Q.features(pa.array(texts))
    docs = [slots[a:b].tolist() for a, b in zip(off[:-1], off[1:])]
    model = Q.fit(slots, off, grades, 2)
    assert list(model.thresholds) == sorted(model.thresholds)
    score = model.scores(slots, off)
    tails, expected = model.tails(score), model.expected(score)
    for k, d in enumerate(docs):
        plain = [1 / (1 + math.exp(t - sum(model.weights[s] for s in d))) for t in model.thresholds]
        assert np.allclose(tails[k], plain, atol=1e-9) and abs(expected[k] - sum(plain)) < 1e-9
    none = np.zeros_like(model.weights)
    for g in (0, 1, 2):
        mine = [k for k in range(len(docs)) if grades[k] == g]
        pick = lambda w, t: loss(w, t, [docs[k] for k in mine], grades[mine].tolist(), 2)
        assert pick(model.weights, model.thresholds) < pick(none, np.array([-0.5, 0.5]))
    assert expected[:200].reshape(-1, 2)[:, 1].min() > expected[:200].reshape(-1, 2)[:, 0].max()


def test_features_of_slices():
    """A document's features do not depend on those beside it."""
    texts = pa.array([GOOD, None, "", "word " * 3000, BAD, "é ß 1234 a|b", "x" * 5000])
    slots, off = Q.features(texts)
    for k in range(len(texts)):
        own, at = Q.features(texts.slice(k, 1))
        assert own[at[0] : at[1]].tolist() == slots[off[k] : off[k + 1]].tolist()


def test_odd_tables(spark):
    """Equal and missing grades, grades beyond the scale, repeated and null ids, null texts, clashing columns."""
    rows = rows_of(120)
    docs = [(k, t) for k, t, _ in rows] + [(1, BAD), (1, BAD), (None, GOOD), (None, None), (500, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 as p_level", "'x' as id", "1 as grade")
    ratings = lambda some: spark.createDataFrame(some, "doc_id long, grade int").selectExpr("*", "'y' as text")
    graded = [(k, g) for k, _, g in rows] + [(None, 2), (3, None), (4, 9), (5, 2), (5, 2), (9_999, 0)]
    model = Q.fit_quality(frame, ratings(graded), 2, 2)
    rated = Q.rate_quality(frame, model, 2, 2).collect()
    assert len(rated) == len(docs) and all(0 <= r.p_level <= 1 and 0 <= r.expected_grade <= 2 for r in rated)
    by_text = {}
    for r in rated:
        by_text.setdefault(r.text or "", set()).add((round(r.expected_grade, 12), round(r.p_level, 12)))
    assert all(len(v) == 1 for v in by_text.values())
    kept = Q.quality_filter(frame, ratings(graded)).collect()
    assert {r.text for r in kept} == {r.text for r in rated if r.p_level >= model.cut}
    for some in ([], [(k, 1) for k, _, _ in rows], [(k, None) for k, _, _ in rows]):
        assert Q.quality_filter(frame, ratings(some)).count() == len(docs)
    assert Q.quality_filter(frame.where("false"), ratings(graded)).count() == 0
