"""Benchmark decontamination by a BM25 index with block-max WAND (operator 4).

Test items make an inverted index: each word's list of items with BM25 impacts, in blocks of
items with the largest impact of each word in a block. Every passage of every document is a
query. Impacts are divided by their item's threshold, so that one bound holds for all:
retrieve at 1 or more. A passage reaches 1 on an item only with one of the item's essential
words (the others don't sum up to 1), which gives the pivots; a pivot's block is scored only
if the sum of its words' block maxima reaches 1. Retrieved items are verified: the passage
must hold 0.8 or more of the question's five-word shingles and of the answer's words. The
threshold of an item is low enough that nothing that would be verified is missed.

Items are indexed by length class, so that a passage is two to four times as long as an item;
passages overlap by half. A benchmark of more than SHARD_ITEMS items is worked in shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import _arrays as A
from tracewright.llm._links import bounded_batches

K1, B = 1.2, 0.75
SHINGLE = 5
BLOCK = 16
#: Items in one broadcast index, and words in it at most.
SHARD_ITEMS, SHARD_WORDS = 20_000, 4_000_000
SLICE_BYTES = 1 << 20
#: Share of an item's words that are its answer, where the benchmark has one text an item.
ANSWER_SHARE = 0.25


@dataclass
class Class:
    """The index of the items of one length class; keys are sorted, values beside them."""

    stride: int
    words: np.ndarray  # hashes of the vocabulary
    pivot_at: np.ndarray  # of each word, its range in pivot_item
    pivot_item: np.ndarray
    item_key: np.ndarray  # word * items + item
    item_value: np.ndarray
    block_key: np.ndarray  # word * blocks + block
    block_value: np.ndarray
    items: int
    names: np.ndarray
    question: list[np.ndarray] = field(default_factory=list)  # distinct shingles
    answer: list[np.ndarray] = field(default_factory=list)  # distinct words


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Hash and document of each word: lower-cased (A-Z), without marks around it; words of marks alone are left out. Also word lengths and the number of documents."""
    raw, off = A.flat(texts)
    start, end, doc = A.words(raw, off)
    s, e = A.bare(raw, start, end)
    ok = e > s
    return A.word_hashes(A.LOWER[raw], s[ok], e[ok]), doc[ok], (e - s)[ok], len(off) - 1


def shingles(h: np.ndarray) -> np.ndarray:
    """Distinct five-word shingles; of fewer words the whole is one."""
    return np.unique(A.rolling(h, min(SHINGLE, len(h)))) if len(h) else np.zeros(0, A.U64)


def build(names: np.ndarray, questions: list[np.ndarray], answers: list[np.ndarray], lengths: dict[int, int], overlap: float) -> list[Class]:
    """Indexes by length class of items given by their word hashes; lengths: bytes of each word."""
    whole = [np.r_[q, a] for q, a in zip(questions, answers, strict=True)]
    size = np.array([len(w) for w in whole])
    if not size.any():
        return []
    mean = size[size > 0].mean()
    df: dict[int, int] = {}
    for w in whole:
        for t in set(w.tolist()):
            df[t] = df.get(t, 0) + 1
    n = int((size > 0).sum())
    out = []
    classes = np.maximum(4, np.ceil(np.log2(np.maximum(size, 1))).astype(int))
    for c in np.unique(classes[size > 0]):
        mine = np.flatnonzero((classes == c) & (size > 0))
        vocabulary = np.unique(np.concatenate([whole[i] for i in mine]))
        blocks = -(-len(mine) // BLOCK)
        pivots: list[tuple[int, int]] = []
        item: dict[int, float] = {}
        block: dict[int, float] = {}
        for k, i in enumerate(mine):
            term, tf = np.unique(whole[i], return_counts=True)
            idf = np.array([np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in term.tolist()])
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[i] / mean))
            # words that a copy may lack and still be verified
            lack = int((1 - overlap) * max(0, len(questions[i]) - SHINGLE + 1) + 1e-9) + int((1 - overlap) * len(set(answers[i].tolist())) + 1e-9)
            bound = impact.sum() - (np.sort(impact)[-lack:].sum() if lack else 0)
            impact = impact / max(bound, 1e-12) * (1 + 1e-9)
            at = np.searchsorted(vocabulary, term)
            # short words are the frequent ones, so these are the words that are not essential
            order = np.argsort([lengths[t] for t in term.tolist()], kind="stable")
            spare = np.cumsum(impact[order]) < 1
            pivots += [(int(at[j]), k) for j in order[~spare]]
            for t, v in zip(at.tolist(), impact.tolist(), strict=True):
                item[t * len(mine) + k] = v
                key = t * blocks + k // BLOCK
                block[key] = max(block.get(key, 0.0), v)
        pivots.sort()
        key = np.array(sorted(item), np.int64)
        b_key = np.array(sorted(block), np.int64)
        term_of = np.array([t for t, _ in pivots], np.int64)
        out.append(Class(
            1 << int(c), vocabulary, np.searchsorted(term_of, np.arange(len(vocabulary) + 1)), np.array([k for _, k in pivots], np.int64),
            key, np.array([item[x] for x in key.tolist()]), b_key, np.array([block[x] for x in b_key.tolist()]), len(mine), names[mine],
            [shingles(questions[i]) for i in mine], [np.unique(answers[i]) for i in mine],
        ))
    return out


def _sums(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.bincount(groups, weights=np.where(keys[at] == wanted, values[at], 0.0), minlength=n)


def retrieve(c: Class, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages (their first and last word) and items that score 1 or more, and the score."""
    none = np.zeros(0, np.int64)
    if not len(h):
        return none, none, none, np.zeros(0)
    term = np.minimum(np.searchsorted(c.words, h), len(c.words) - 1)
    known = c.words[term] == h
    first = np.searchsorted(doc, doc)  # of the word's document
    last = np.searchsorted(doc, doc, "right")
    many = np.where(known, c.pivot_at[term + 1] - c.pivot_at[term], 0)
    hit = np.flatnonzero(many)
    if not len(hit):
        return none, none, none, np.zeros(0)
    n = many[hit]
    which = c.pivot_item[np.repeat(c.pivot_at[term[hit]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    word = np.repeat(hit, n)
    step = (word - first[word]) // c.stride
    # a word lies in the passage that begins in its own stride, and in the one before
    begin = np.r_[first[word] + step * c.stride, first[word] + np.maximum(step - 1, 0) * c.stride]
    pair = np.unique(begin * c.items + np.r_[which, which])
    begin, which = pair // c.items, pair % c.items
    passage, of = np.unique(begin, return_inverse=True)
    end = np.minimum(passage + 2 * c.stride, last[passage])
    # the distinct known words of those passages
    size = end - passage
    row = np.repeat(np.arange(len(passage)), size)
    at = np.repeat(passage - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    ok = known[at]
    flat = np.unique(row[ok] * len(c.words) + term[at[ok]])
    row, word = flat // len(c.words), flat % len(c.words)
    upto = np.searchsorted(row, np.arange(len(passage) + 1))
    blocks = -(-c.items // BLOCK)

    def score(rows: np.ndarray, column: np.ndarray, keys: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(len(rows))
        many = upto[rows + 1] - upto[rows]
        cut = np.flatnonzero(np.diff(np.cumsum(many) // 4_000_000)) + 1
        for part in np.split(np.arange(len(rows)), cut):
            m = many[part]
            at = np.repeat(upto[rows[part]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            group = np.repeat(np.arange(len(part)), m)
            out[part] = _sums(keys, values, word[at] * width + column[part][group], group, len(part))
        return out

    pairs, back = np.unique(of * blocks + which // BLOCK, return_inverse=True)
    enough = score(pairs // blocks, pairs % blocks, c.block_key, c.block_value, blocks) >= 1
    live = np.flatnonzero(enough[back])
    got = score(of[live], which[live], c.item_key, c.item_value, c.items)
    live, got = live[got >= 1], got[got >= 1]
    return passage[of[live]], end[of[live]], which[live], got


def leaks(index: list[Class], texts: pa.Array, overlap: float) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(row, item id) -> best score, question overlap and answer overlap."""
    h, doc, _, _ = tokens(texts)
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    for c in index:
        for a, b, k, score in zip(*(x.tolist() for x in retrieve(c, h, doc)), strict=True):
            q, words = c.question[k], c.answer[k]
            asked = np.isin(q, A.rolling(h[a:b], SHINGLE if b - a >= SHINGLE and len(q) else max(1, b - a))).mean() if len(q) else 1.0
            if len(q) == 1 and asked < 1 and b - a > 0:  # a question of fewer than five words is one short shingle
                asked = max(float(q[0] in set(A.rolling(h[a:b], n).tolist())) for n in range(1, SHINGLE + 1) if b - a >= n)
            answered = np.isin(words, h[a:b]).mean() if len(words) else 1.0
            if asked >= overlap - 1e-9 and answered >= overlap - 1e-9:
                key = int(doc[a]), int(c.names[k])
                found[key] = max(found.get(key, (0.0, 0.0, 0.0)), (float(score), float(asked), float(answered)))
    return found


def indexes(benchmark: DataFrame, overlap: float, item_col: str, question_col: str, answer_col: str | None) -> Iterator[list[Class]]:
    """One index a shard of the benchmark; shards are bounded in items and words."""
    text = F.col(question_col).cast("string")
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), text.alias("q"), answer.alias("a")).where("i is not null").orderBy("i", "q", "a")
    names, questions, answers, lengths = [], [], [], {}
    words = 0
    for row in rows.toLocalIterator():
        hq, _, nq, _ = tokens(pa.array([row.q or ""]))
        ha, _, na, _ = tokens(pa.array([row.a or ""]))
        if answer_col is None:
            cut = len(hq) - int(len(hq) * ANSWER_SHARE)
            hq, ha, nq, na = hq[:cut], hq[cut:], nq[:cut], nq[cut:]
        names.append(row.i)
        questions.append(hq)
        answers.append(ha)
        lengths.update(zip(np.r_[hq, ha].tolist(), np.r_[nq, na].tolist(), strict=True))
        words += len(hq) + len(ha)
        if len(names) >= SHARD_ITEMS or words >= SHARD_WORDS:
            yield build(np.array(names, np.int64), questions, answers, lengths, overlap)
            names, questions, answers, lengths, words = [], [], [], {}, 0
    if names:
        yield build(np.array(names, np.int64), questions, answers, lengths, overlap)


def find_leaks(docs: DataFrame, benchmark: DataFrame, overlap: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", question_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap of each leak.

    score is BM25 over the item's own threshold. An item of one text has its last quarter of
    words as the answer. Items without words, or with a null id, match nothing; null texts
    neither. Items of one id are indexed each, and the best counts. Rows of docs with the same
    or a null id are searched each. Empty tables give no rows.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for index in indexes(benchmark, overlap, item_col, question_col, answer_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def act(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in A.slices(batch, "text", SLICE_BYTES):
                    found = leaks(shared.value, part.column(1), overlap)
                    ids = part.column(0).take(pa.array([r for r, _ in found], pa.int64()))
                    numbers = [pa.array([v[k] for v in found.values()], pa.float64()) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([i for _, i in found], pa.int64()), *numbers], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        got = rows.mapInArrow(act, schema)
        out = got if out is None else out.unionByName(got)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, overlap: float = 0.8, text_col: str = "text", **columns: str) -> DataFrame:
    """The rows of docs without a leak (find_leaks), with all their columns, whatever their names.

    Rows are judged by their texts alone, so ids may be null or repeated; null and empty texts
    stay, and so do all where the benchmark is empty. An empty table gives no rows. A benchmark
    of several shards is one pass over docs each; an index is a broadcast of at most
    SHARD_ITEMS items and about SHARD_WORDS words.
    """
    names = {"item_col": "item_id", "question_col": "text", "answer_col": None} | columns
    bounded_batches(docs.sparkSession)
    schema = docs.schema
    for index in indexes(benchmark, overlap, **names):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def act(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in A.slices(batch, text_col, SLICE_BYTES):
                    keep = np.ones(part.num_rows, dtype=bool)
                    keep[[r for r, _ in leaks(shared.value, part.column(part.schema.get_field_index(text_col)), overlap)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(act, schema)
    return docs
