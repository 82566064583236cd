"""Decontamination against verifying every item in every passage."""

import math
import random

from tests.llm import brute
from tracewright.llm.decontaminate import ANSWER_SHARE, SHINGLE, decontaminate, find_leaks

MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words(text):
    """Lower-cased words without marks around them (these tests have four at most)."""
    return [w for w in (x.strip(MARKS) for x in brute.WORDS.findall((text or "").translate(brute.LOWER))) if w]


def runs(w, n):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def expected(docs, items, overlap=0.8):
    out = set()
    for item, text in items:
        whole = words(text)
        if item is None or not whole:
            continue
        cut = len(whole) - int(len(whole) * ANSWER_SHARE)
        question, answer = whole[:cut], set(whole[cut:])
        stride = 1 << max(4, math.ceil(math.log2(len(whole))))
        n = min(SHINGLE, len(question))
        asked = runs(question, n)
        for row, (_, text) in enumerate(docs):
            w = words(text)
            for a in range(0, max(1, len(w)), stride):
                passage = w[a : a + 2 * stride]
                held = len(asked & runs(passage, n)) / len(asked)
                if held >= overlap - 1e-9 and (not answer or len(answer & set(passage)) / len(answer) >= overlap - 1e-9):
                    out.add((row, item))
    return out


def cases(rng):
    vocabulary = [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.randrange(400)}" for _ in range(600)]
    common = ["the", "of", "and", "in", "is"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary)
    some = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(some(rng.choice([1, 2, 4, 5, 6, 9, 16, 17, 30, 64, 120])))) for k in range(60)]
    items += [(7, items[20][1]), (100, items[30][1]), (101, ""), (102, None), (None, " ".join(some(20))), (103, "?! ..."), (104, "same " * 30)]
    docs = []
    for k in range(160):
        body = some(rng.randrange(0, 300))
        if k % 4:
            w = words(rng.choice(items)[1] or "")
            for _ in range(rng.choice([0, 0, 1, 2, 3, len(w) // 8, len(w) // 4])):  # altered, cut and grown copies
                if w:
                    at = rng.randrange(len(w))
                    w[at : at + 1] = rng.choice([[], [word()], [w[at], word()]])
            at = rng.randrange(len(body) + 1)
            body[at:at] = w
        docs.append((k, " ".join(x.upper() if rng.random() < 0.1 else f'"{x}",' if rng.random() < 0.1 else x for x in body)))
    return docs + [(3, None), (None, items[30][1]), (None, items[30][1]), (5, ""), (5, "word " * 500), (6, items[40][1])], items


def test_against_every_passage(spark):
    for seed in (1, 2):
        docs, items = cases(random.Random(seed))
        told = [(k, text) for k, (_, text) in enumerate(docs)]
        frame = spark.createDataFrame(told, "doc_id long, text string").selectExpr("*", "1 as item_id", "0.5 as score")
        bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as doc_id")
        want = expected(docs, items)
        got = {(r.doc_id, r.item_id) for r in find_leaks(frame, bench).collect()}
        assert got == want and len(want) > 50
        kept = {r.doc_id for r in decontaminate(frame, bench).collect()}
        assert kept == {k for k, _ in told} - {k for k, _ in want}


def test_rows_of_one_id(spark):
    docs, items = cases(random.Random(3))
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted((-1 if docs[k][0] is None else docs[k][0], i) for k, i in expected(docs, items))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in find_leaks(frame, bench).collect()) == want
    assert decontaminate(frame, bench.where("false")).count() == len(docs)
    assert find_leaks(frame, bench.where("false")).count() == 0
