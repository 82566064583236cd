"""Groups of near-duplicates against all pairs of shingle sets."""

import random

import numpy as np
import pyarrow as pa

from tests.llm import brute
from tracewright.llm.near_duplicates import Spreads, drop_near_duplicates, near_duplicates, packed, shingle_set, spread_of, unpacked


def words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]


def groups(docs):
    """doc_id -> the smallest doc_id that links at 0.8 on sets of five-word shingles reach."""
    sets = []
    for _, text in docs:
        w = (text or "").translate(brute.LOWER).split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 10 * len(a & b) >= 8 * len(a | b):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    low = {}
    for i, (doc, _) in enumerate(docs):
        low[root(i)] = min(doc, low.get(root(i), doc))
    return {doc: low[root(i)] for i, (doc, _) in enumerate(docs)}


def got(spark, docs):
    return {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def test_repeated_phrases(spark):
    """A run of one repeated word or phrase leaves the set of shingles nearly as it was."""
    rng, texts = random.Random(1), []
    for k in range(12):
        w = words(rng, 100 + 20 * k)
        texts += [w, w + ["loop"] * (20 + 10 * k), w + ["again", "and"] * (20 + 10 * k)]
    docs = [(10 * k, " ".join(w)) for k, w in enumerate(texts)]
    want = groups(docs)
    assert len(set(want.values())) == 12
    assert got(spark, docs) == want


def least(text):
    return int(shingle_set(text.encode(), 5)[0][0])


def test_no_common_least_hash(spark):
    """Pairs at 0.8 or just above that do not share their least shingle; others just below 0.8 stay apart."""
    rng, docs, missed = random.Random(2), [], 0
    while missed < 12:
        w = words(rng, 98)
        a, b = " ".join(w[:89]), " ".join(w[9:])  # 85 shingles each, 76 in common
        if least(a) != least(b):
            missed += 1
            docs += [(len(docs), a), (len(docs) + 1, b)]
    for k in range(40):
        w, n = words(rng, 200), rng.randrange(40, 90)
        docs += [(len(docs), " ".join(w[: n + 4])), (len(docs) + 1, " ".join(w[k % 12 : n + 4 + k % 12]))]
    page = words(rng, 30)
    docs += [(len(docs) + k, " ".join(page + words(rng, 3 + k % 6))) for k in range(60)]
    docs += [(9_000, ""), (9_001, None), (9_002, "one two"), (9_003, "One  TWO")]
    want = groups(docs)
    assert len(np.unique(list(want.values()))) < len(docs) - 20
    assert got(spark, docs) == want


def test_one_row_a_group(spark):
    """Repeated and null ids, equal rows, clashing columns: one row of each group of texts stays."""
    rng = random.Random(5)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [(5, a, 1), (5, b, 2), (2, a + " more", 3), (9, b, 4), (9, b, 4), (None, c, 5), (None, c, 6), (7, None, 7), (8, "", 8), (11, c, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long").selectExpr("*", "'x' as node", "1 as _id")
    kept = sorted((r.doc_id or 0, r.component_id) for r in drop_near_duplicates(docs).collect())
    assert kept == [(0, 5), (0, 6), (2, 3), (5, 2), (7, 7), (11, 9)]
    assert drop_near_duplicates(docs).columns == docs.columns
    assert drop_near_duplicates(docs.where("false")).count() == 0


def test_a_table_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got(spark, rows) == groups(rows)


def test_counts_bound_what_is_shared():
    """The counts never say less than two sets share, whatever their sizes up to a factor of 1.25."""
    rng = np.random.default_rng(6)
    for n in (1, 3, 15, 16, 17, 63, 64, 500, 1000, 20_000):
        a = np.unique(rng.integers(0, 1 << 40, n, dtype=np.int64)).astype(np.uint64)
        for share in (0.0, 0.5, 1.0):
            more = np.unique(rng.integers(0, 1 << 40, max(1, n // 5), dtype=np.int64)).astype(np.uint64)
            b = np.unique(np.r_[a[: int(len(a) * share)], rng.integers(0, 1 << 40, int(len(a) * (1 - share)) + 1, dtype=np.int64).astype(np.uint64), more[: len(a) // 5]])
            small, large = sorted((a, b), key=len)
            most = Spreads([spread_of(small), spread_of(large)]).shared(0, np.array([1]))[0]
            assert len(np.intersect1d(a, b)) <= most <= len(small)
            assert np.array_equal(unpacked(pa.array([packed(small), b"", packed(large)], pa.binary()))[2], large)
