"""Quality classifier: ordinal cumulative-link regression on graded ratings (operator 10).

A document's features are hashed: the words that it holds, and the levels of some measures of
its style (how many words are capitals, carry marks, repeat and so on). One weight vector is
shared by all grades, and ordered thresholds part them: P(grade <= j) = s(threshold_j - w x)
with the logistic s. The model is fitted on a bounded sample of the rated documents; it gives
the expected grade and the probability of the top grades, by which documents are selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import _arrays as A
from tracewright.llm._links import bounded_batches

BITS = 18
#: Rated documents that the model is fitted on, at most; they are the first by a hash of the id.
FIT_ROWS = 8000
#: Texts whose features are made at a time, in bytes.
SLICE_BYTES = 1 << 20
CLASSES = np.zeros(256, np.uint8)
CLASSES[48:58] = 1
CLASSES[65:91] = 2
CLASSES[97:123] = 3
CLASSES[128:] = 4
LEVELS = 12
#: Bytes of a word's beginning that are features of their own.
BEGINNINGS = (4, 5)


def _level(share: np.ndarray) -> np.ndarray:
    """Level of a share from 0 to 1, finer towards 0."""
    return np.clip(np.ceil(np.log2(np.maximum(share, 1e-9) * 2048)), 0, LEVELS - 1).astype(np.int64)


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all documents' features, one after the other, and where each document's begin."""
    raw, off = A.flat(texts)
    n_docs = len(off) - 1
    start, end, doc = A.words(raw, off)
    low = A.LOWER[raw]
    s, e = A.bare(raw, start, end)
    bare = e > s
    h = A.word_hashes(low, s[bare], e[bare])
    d = doc[bare]
    # the beginnings of longer words, too
    for k in BEGINNINGS:
        long = e - s > k
        h = np.r_[h, A.mix(A.word_hashes(low, s[long], s[long] + k) + A.U64(k))]
        d = np.r_[d, doc[long]]
    count = np.maximum(np.bincount(doc, minlength=n_docs), 1)

    kind = CLASSES[raw]

    def per_word(flag: np.ndarray) -> np.ndarray:
        # white space has no flag, so a word's sum may run to the next word's start
        return np.add.reduceat(flag, start, dtype=np.int32) if len(start) else np.zeros(0, np.int32)

    size = end - start
    upper, lower, marks, digits = (per_word(kind == 2), per_word(kind == 3), per_word(A.MARK[raw]), per_word(kind == 1))
    share = lambda flag: np.bincount(doc, weights=flag, minlength=n_docs) / count
    whole = A.word_hashes(low, start, end)
    same = np.r_[False, (whole[1:] == whole[:-1]) & (doc[1:] == doc[:-1])] if len(whole) else np.zeros(0, dtype=bool)
    slot = (h >> A.U64(64 - bits)).astype(np.int64)
    pair = np.unique(d.astype(np.int64) << bits | slot)
    distinct = np.bincount(pair >> bits, minlength=n_docs) / count
    lines = np.bincount(np.searchsorted(off, np.flatnonzero(raw == 10), "right") - 1, minlength=n_docs)[:n_docs] / count if len(raw) else np.zeros(n_docs)
    longest = np.zeros(n_docs)
    np.maximum.at(longest, doc, size)
    measures = (
        share((upper > 1) & (lower == 0)), share(marks >= 2), share((marks > 0) & (size > marks + 1)), share(same), share((size == 1) & (marks == 1)), share(digits > 0),
        np.minimum(1, share(size) / 40), distinct, np.minimum(1, longest / 200), lines, np.minimum(1, np.log2(count + 1) / 20),
    )
    extra = [pair]
    for k, m in enumerate(measures):
        name = A.mix(np.arange(LEVELS, dtype=A.U64) + A.U64(1000 * (k + 1)))
        extra.append(np.arange(n_docs, dtype=np.int64) << bits | (name[_level(m)] >> A.U64(64 - bits)).astype(np.int64))
    out = np.unique(np.concatenate(extra))
    return (out & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(out, np.arange(n_docs + 1, dtype=np.int64) << bits)


@dataclass(frozen=True)
class Ordinal:
    """Shared weights, and one threshold less than there are grades."""

    weights: np.ndarray
    thresholds: np.ndarray
    cut: float

    def scores(self, slots: np.ndarray, off: np.ndarray) -> np.ndarray:
        upto = np.r_[0.0, np.cumsum(self.weights[slots], dtype=np.float64)]
        return upto[off[1:]] - upto[off[:-1]]

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.tails(score).sum(axis=1)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1..top, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def fit(slots: np.ndarray, off: np.ndarray, grade: np.ndarray, top: int, bits: int = BITS, rounds: int = 400, l1: float = 2e-3, rate: float = 0.1, least_docs: int = 5) -> Ordinal:
    """Minimises the cumulative-link loss with an L1 penalty by proximal Adam steps; classes weigh alike."""
    n = len(grade)
    doc = np.repeat(np.arange(n), np.diff(off))
    often = np.bincount(slots, minlength=1 << bits) >= least_docs
    keep = often[slots]
    slots, doc = slots[keep], doc[keep]
    used, col = np.unique(slots, return_inverse=True)
    freq = np.bincount(grade, minlength=top + 1)
    weight = (n / np.maximum(freq, 1) / max(1, (freq > 0).sum()))[grade] ** 0.5 / n
    w, gap = np.zeros(len(used)), np.full(top, 0.5)
    gap[0] = -0.5
    m, v, mg, vg = np.zeros_like(w), np.zeros_like(w), np.zeros(top), np.zeros(top)
    for t in range(1, rounds + 1):
        theta = np.r_[gap[0], gap[0] + np.cumsum(np.exp(gap[1:]))]
        score = np.bincount(doc, weights=w[col], minlength=n)
        upper = np.where(grade < top, theta[np.minimum(grade, top - 1)] - score, 60.0)
        lower = np.where(grade > 0, theta[np.maximum(grade - 1, 0)] - score, -60.0)
        fu, fl = 1 / (1 + np.exp(-np.clip(upper, -60, 60))), 1 / (1 + np.exp(-np.clip(lower, -60, 60)))
        p = np.maximum(fu - fl, 1e-9)
        du, dl = fu * (1 - fu) / p, fl * (1 - fl) / p
        g_score = weight * (du - dl)
        g = np.bincount(col, weights=g_score[doc], minlength=len(used))
        g_theta = np.bincount(np.minimum(grade, top - 1), weights=np.where(grade < top, -weight * du, 0), minlength=top) + np.bincount(np.maximum(grade - 1, 0), weights=np.where(grade > 0, weight * dl, 0), minlength=top)
        tail = np.cumsum(g_theta[::-1])[::-1]
        gg = np.r_[tail[0], tail[1:] * np.exp(gap[1:])]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mg, vg = 0.9 * mg + 0.1 * gg, 0.99 * vg + 0.01 * gg * gg
        c, cv = 1 - 0.9**t, 1 - 0.99**t
        step = rate / (np.sqrt(v / cv) + 1e-5)
        w = w - step * m / c
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1 * 0.1, 0)
        gap = gap - rate * (mg / c) / (np.sqrt(vg / cv) + 1e-8)
    theta = np.r_[gap[0], gap[0] + np.cumsum(np.exp(gap[1:]))]
    full = np.zeros(1 << bits, np.float64)
    full[used] = w
    return Ordinal(full, theta, 0.5)


def calibrated(model: Ordinal, slots: np.ndarray, off: np.ndarray, grade: np.ndarray, level: int) -> float:
    """The least probability of `level` or more that parts rows of those grades from the others best, midway between ties."""
    tail, good = model.tails(model.scores(slots, off))[:, level - 1], grade >= level
    if good.all() or not good.any():
        return 0.5
    cuts = np.arange(1, 100) / 100
    worth = np.array([(tail[good] >= c).mean() - (tail[~good] >= c).mean() for c in cuts])
    return float(np.median(cuts[worth >= worth.max() - 1e-12]))


def fit_quality(docs: DataFrame, ratings: DataFrame, top: int, level: int, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Ordinal | None:
    """The model of a bounded sample of rated documents: the `fit_rows` first by a hash of the id.

    A quarter of them is held out to calibrate the cut. A null id, a null grade or one beyond
    0..top is left out; of several grades of one id the least counts. None where the sample
    has fewer than two grades.
    """
    bounded_batches(docs.sparkSession)
    rated = ratings.select(F.col(id_col).cast("long").alias("_id"), F.col(grade_col).cast("int").alias("_grade")).where(F.col("_id").isNotNull() & F.col("_grade").between(0, top))
    some = rated.groupBy("_id").agg(F.min("_grade").alias("_grade")).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, "text", SLICE_BYTES):
                slots, off = features(part.column(1))
                each = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(slots, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), each], ["id", "grade", "slots"])

    # at most fit_rows rows of two integers are broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), F.col("id") == F.col("_id")).select("id", "text", F.col("_grade").alias("grade"))
    got = texts.mapInArrow(act, "id long, grade int, slots array<int>").toArrow().combine_chunks()
    if not got.num_rows:
        return None
    ids, grade = got["id"].to_numpy(), got["grade"].to_numpy().astype(np.int64)
    if len(np.unique(grade)) < 2:
        return None
    lists = got["slots"].combine_chunks()
    off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    order = np.lexsort((A.mix(ids.astype(np.int64).view(A.U64)),))

    def rows(some: np.ndarray):
        n = off[some + 1] - off[some]
        head = np.cumsum(n) - n
        return flat[np.repeat(off[some] - head, n) + np.arange(int(n.sum()))], np.r_[head, n.sum()], grade[some]

    held = max(1, len(order) // 4)
    learn, check = (order[held:], order[:held]) if len(order) >= 40 else (order, order)
    slots, at, g = rows(learn)
    if len(np.unique(g)) < 2:
        slots, at, g = rows(order)
    model = fit(slots, at, g, top)
    return Ordinal(model.weights, model.thresholds, calibrated(model, *rows(check), level))


def rate_quality(docs: DataFrame, model: Ordinal | None, top: int, level: int, text_col: str = "text") -> DataFrame:
    """docs with expected_grade and p_level, the probability of `level` or more; columns of those names are replaced.

    Null text is empty. Without a model all rows get the top grade and probability 1. Weights
    go to the workers as a broadcast of a fixed size.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("expected_grade", "p_level")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "expected_grade double", "p_level double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            names = batch.schema.names
            for part in A.slices(batch, text_col, SLICE_BYTES):
                if known is None:
                    expected, tail = np.full(part.num_rows, float(top)), np.ones(part.num_rows)
                else:
                    score = known.scores(*features(part.column(names.index(text_col))))
                    expected, tail = known.expected(score), known.tails(score)[:, level - 1]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(expected), pa.array(tail)], [*names, "expected_grade", "p_level"])

    return docs.mapInArrow(act, schema)


def quality_filter(docs: DataFrame, ratings: DataFrame, top: int = 2, level: int = 2, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> DataFrame:
    """The documents whose probability of `level` or more reaches the calibrated cut, with expected_grade and p_level.

    All rows are rated, whatever the sample. Rows with null or repeated ids are rated by their
    texts like any others; null text is empty. An empty table gives no rows, and without
    ratings of two grades nothing is rejected.
    """
    model = fit_quality(docs, ratings, top, level, fit_rows, id_col, text_col, grade_col)
    return rate_quality(docs, model, top, level, text_col).where(F.col("p_level") >= F.lit(model.cut if model else 0.0))
