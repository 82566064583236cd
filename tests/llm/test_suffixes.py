"""The arrays of operator 7 against brute force, and its results on repeated ids and long texts."""

import random

import numpy as np
import pytest

from tests.llm import brute
from tracewright.llm import suffix_dedup as S


def common(a: bytes, b: bytes) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("jumps", [0, 2, 48])
@pytest.mark.parametrize("length,letters", [(1, 2), (5, 2), (8, 2), (12, 2), (16, 1), (20, 3), (50, 2), (11, 256)])
def test_factors(monkeypatch, jumps, length, letters):
    monkeypatch.setattr(S, "JUMPS", jumps)
    rng = np.random.default_rng(length * 7 + letters)
    for n in (1, 2, 90):
        text = (rng.integers(0, letters, n + length) + (256 - letters if letters < 4 else 0)).astype(np.uint8)
        if n > 50:
            text[40:60] = text[10:30]
        at = np.sort(rng.choice(n, max(1, n - 5), replace=False))
        doc = rng.integers(0, max(1, n // 4) + 1, len(at))
        raw = [text[i : i + length].tobytes() for i in at.tolist()]
        order, lcp = S.suffix_order(text, at, length)
        assert [raw[i] for i in order] == sorted(raw)
        assert lcp[1:].tolist() == [common(raw[i], raw[j]) for i, j in zip(order[1:], order[:-1])]
        want = [max([common(x, y) for y, e in zip(raw, doc) if e < d], default=0) for x, d in zip(raw, doc)]
        assert S.longest_previous(text, at, doc, length).tolist() == want


def test_smaller_places():
    value, lcp = np.array([3, 1, 4, 1, 5, 9, 2, 6]), np.array([0, 5, 4, 3, 6, 7, 2, 8])
    place, shared = S.previous_smaller(value, lcp)
    assert place.tolist() == [-1, -1, 1, -1, 3, 4, 3, 6] and shared.tolist() == [0, 0, 4, 0, 6, 7, 2, 8]
    rising = np.r_[np.arange(1, 5000), 0, 0]
    assert S.previous_smaller(rising, np.full(len(rising), 9))[0].tolist() == [-1, *range(4998), -1, -1]


def got(spark, rows, length):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as n_bytes").repartition(3)
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in S.suffix_dedup(docs, length=length).collect())


def expected(rows, length):
    """As the contract says; rows of one id and nulls, which count as the largest, are not earlier than each other."""
    least = {}
    for d, t in rows:
        b, d = (t or "").encode(), 2**63 if d is None else d
        for i in range(len(b) - length + 1):
            least[b[i : i + length]] = min(d, least.get(b[i : i + length], d))
    out = []
    for d, t in rows:
        b, gone = (t or "").encode(), set()
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < (2**63 if d is None else d):
                gone.update(range(i, i + length))
        runs = sum(i - 1 not in gone for i in gone)
        out.append((-1 if d is None else d, len(b), len(gone), runs, brute.sha(bytes(x for i, x in enumerate(b) if i not in gone))))
    return sorted(out)


def test_rows_of_one_id(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abé") for _ in range(n))
    base = text(200)
    rows = [(4, base), (4, base), (4, text(90)), (None, base[50:120]), (None, base[50:120]), (9, text(20) + base[100:180]), (2, base[:60] + text(10)), (3, None), (5, ""), (7, "x" * 300), (8, "x" * 120)]
    for length in (7, 24, 50):
        assert got(spark, rows, length) == expected(rows, length)


def test_long_text(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2_000_000))
    rows = [(1, long), (2, "y" + long[5000:5300] + "y"), (3, "z" * 1_000_000), (4, "z" * 60)]
    assert [r[:4] for r in got(spark, rows, 50)] == [(1, 2_000_000, 0, 0), (2, 302, 300, 1), (3, 1_000_000, 0, 0), (4, 60, 60, 1)]
