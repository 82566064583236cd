"""Three-phase top-k: against all pairs, on odd vectors, and how many products the thresholds save."""

import random

import numpy as np

from tracewright.llm import topk_search as T


def expected(vectors, queries, k):
    whole = [(i, np.floor(256 * np.array(v, np.float64)).astype(object)) for i, v in vectors if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = [(i, np.floor(256 * np.array(v, np.float64)).astype(object)) for i, v in queries if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, seen = {}, set()
    for i, q in asked:
        if (i, tuple(q)) not in seen:
            seen.add((i, tuple(q)))
            out.setdefault(i, []).extend((-int((q * x).sum()), j) for j, x in whole if j != i and len(x) == len(q))
    return sorted((i, r, j, -s) for i, best in out.items() for r, (s, j) in enumerate(sorted(best)[:k], 1))


def got(spark, vectors, queries, k, **options):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as place", "'x' as data")
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in T.top_k(frame(vectors), frame(queries), k, **options).collect())


def test_odd_vectors(spark):
    rng = random.Random(1)
    vectors = [(k, [rng.uniform(-1, 1) for _ in range(6)]) for k in range(60)]
    vectors += [(3, vectors[9][1]), (3, vectors[9][1]), (70, vectors[9][1]), (71, [0.0] * 6), (72, [0.0] * 6), (73, [0.5, 0.5]), (74, [1.0, -1.0]), (75, []), (76, [])]
    vectors += [(80, None), (81, [None] * 6), (82, [float("nan")] * 6), (None, [0.1] * 6), (90, [2.0**20] * 6), (91, [-(2.0**20)] * 6)]
    queries = [v for v in vectors if v[0] is None or v[0] % 5 == 0 or v[0] in (3, 73, 91)]
    for k, slices in ((5, 4), (1, 1), (100, 3), (3, 9)):
        small = [v for v in queries if v[0] != 90]
        assert got(spark, vectors, small, k, slices=slices) == expected(vectors, small, k)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(T, "QUERY_BYTES", 1 << 10)
    rng = random.Random(2)
    vectors = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(200)]
    assert got(spark, vectors, vectors[::9], 4) == expected(vectors, vectors[::9], 4)


def test_products_saved():
    """On clustered vectors the lists' bounds leave out most blocks in both passes."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32)) * 400
    blocks = [np.floor(c + rng.normal(size=(200, 32)) * 10) for c in centres]
    ids = [np.arange(200) + 1000 * k for k in range(40)]
    queries = T.Queries(0, np.arange(40) * 1000, np.array([b[0] for b in blocks]))
    parts = T.parts_of(32, 4)

    def lists(part):
        for place, (i, b) in enumerate(zip(ids, blocks)):
            x = np.ascontiguousarray(b[:, part])
            centre = x.mean(axis=0)
            yield place, T.Scores(i, x, centre, float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()))

    first = second = 0
    for part in parts:
        top = T.Tops(queries, part, 5)
        for place, found in lists(part):
            top.meet(place, found)
        first += top.scored
    whole = np.concatenate(blocks)
    score = queries.x @ whole.T
    score[np.concatenate(ids)[None, :] == queries.ids[:, None]] = -np.inf
    queries.cutoff = np.sort(score, axis=1)[:, -5]
    met = set()
    for part in parts:
        for place, found in lists(part):
            q, at, n = T.reaching(queries, part, len(parts), found)
            second += n
            met |= {(a, int(found.ids[b])) for a, b in zip(q.tolist(), at.tolist())}
    every = 40 * 8000 * len(parts)
    assert first < 0.5 * every and second < 0.5 * every
    for i in range(40):
        assert {(i, int(v)) for v in np.concatenate(ids)[score[i] >= queries.cutoff[i]]} <= met
