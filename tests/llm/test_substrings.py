"""Substring dedup on repeated and null ids, words that a weak hash takes for one another, and long texts."""

import random
from collections import Counter

from tests.llm import brute
from tracewright.llm.substring_dedup import levels, substring_dedup


def expected(rows, window):
    """As the contract says, a row being a document of its own."""
    out = brute.op1([(k, t) for k, (_, t) in enumerate(rows)], window)
    return sorted((rows[k][0] or -1, n, gone, kept) for k, n, gone, kept in out)


def got(spark, rows, window, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "'x' as payload").repartition(3)
    out = substring_dedup(docs, window=window, **options).collect()
    return sorted((r.doc_id or -1, r.n_words, r.n_removed, brute.sha(r.kept_text)) for r in out)


def test_levels():
    assert levels(9, 35) == [9, 18, 35] and levels(9, 9) == [9] and levels(50, 9) == [9] and levels(1, 5) == [1, 2, 4, 5]


def test_rows_of_one_id(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    rows = [(1, text(60)), (1, text(60)), (None, text(40)), (None, text(40)), (None, None), (2, ""), (3, "a " * 30)]
    rows += [(5, rows[0][1])] * 2 + [(None, rows[2][1])] * 3
    for window, base in ((7, 2), (5, 9), (12, 3), (1, 1)):
        assert got(spark, rows, window, base=base) == expected(rows, window)


def test_words_of_one_weak_hash(spark):
    """A Thue-Morse word of 4,096 letters and its complement collide under any polynomial hash modulo 2**64."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    around = [f"w{k}" for k in range(34)]
    rows = [(1, " ".join([*around, word])), (2, " ".join([*around, word.translate(str.maketrans("ab", "ba"))]))]
    assert [r[2] for r in got(spark, rows, 35)] == [0, 0]
    assert [r[2] for r in got(spark, [*rows, rows[0]], 35)] == [35, 35, 0]


def test_long_text(spark):
    """A text of 3 MB with a passage that another one holds, and one word of 2 MB."""
    rng = random.Random(7)
    words = [f"{rng.randrange(10**9):x}" for _ in range(400_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[1000:1050])), (3, "z" * 2_000_000)]
    counts = {r[0]: r[1:3] for r in got(spark, rows, 35)}
    assert counts == {1: (400_000, 50), 2: (50, 50), 3: (1, 0)}
    assert Counter(words).most_common(1)[0][1] < 35
