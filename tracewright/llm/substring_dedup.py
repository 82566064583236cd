"""Substring dedup by level-wise doubling (operator 1).

Level by level the starts of repeated windows are extended: the windows of `base` words that
repeat come first; a window of twice the length can repeat only if both its halves do, and so
on up to `window` words (there the two halves overlap), until no candidate is left. Only
candidates are compared at a level. Up to the last level keys are the upper bytes of a 64-bit
hash, so a chance match costs work and no wrong answer; at the last level they are 128 bits,
from two independent hashes of each word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import _arrays as A
from tracewright.llm import _rounds as R
from tracewright.llm._links import bounded_batches

OUT = "doc_id long, n_words long, n_removed long, kept_text string"


def levels(base: int, window: int) -> list[int]:
    """base, doubled until the window's own length."""
    out = []
    while base < window:
        out.append(base)
        base *= 2
    return [*out, window]


def key_bytes(total: int) -> int:
    """Bytes of a key before the last level: enough that few of the keys in `total` bytes of text match by chance."""
    return min(8, max(4, -(-(int(total).bit_length() + 6) // 8)))


def _order(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and whether each place in it begins a distinct key."""
    order = np.argsort(a, kind="stable") if b is None else np.lexsort((b, a))
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[order][1:] != a[order][:-1]
    if b is not None:
        new[1:] |= b[order][1:] != b[order][:-1]
    return order, new


class Part:
    """The words of one part's texts, and the windows that are still candidates at a level."""

    def __init__(self, texts: pa.Array, sizes: list[int], width: int):
        self.buf, self.off = A.flat(texts)
        self.start, self.end, self.doc = A.words(self.buf, self.off)
        self.hash = A.word_hashes(self.buf, self.start, self.end)
        self.sizes, self.width = sizes, width
        self.n_words = np.bincount(self.doc, minlength=len(self.off) - 1)

    def _inside(self, size: int) -> np.ndarray:
        """Starts whose window lies in one text."""
        n = len(self.doc) - size + 1
        return self.doc[:n] == self.doc[size - 1 :] if n > 0 else np.zeros(0, dtype=bool)

    def candidates(self, level: int, repeated: np.ndarray | None) -> np.ndarray:
        """Starts at a level: of texts that hold a whole window; later on, where both halves are repeated."""
        inside = self._inside(self.sizes[level])
        if not level:
            return inside & (self.n_words[self.doc[: len(inside)]] >= self.sizes[-1])
        far = self.sizes[level] - self.sizes[level - 1]
        return inside & repeated[: len(inside)] & repeated[far : far + len(inside)]

    def keys(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
        """Distinct keys of the windows that start at the places, in order; whether each is found twice here; each place's key."""
        size, last = self.sizes[level], level == len(self.sizes) - 1
        a, b = A.rolling(self.hash, size)[at], None
        if last:
            b = A.rolling(A.word_hashes(self.buf, self.start, self.end, A.BASE2), size)[at]
        else:
            a = a >> A.U64(64 - 8 * self.width) << A.U64(64 - 8 * self.width)
        order, new = _order(a, b)
        head = np.flatnonzero(new)
        of = np.empty(len(a), np.int64)
        of[order] = np.cumsum(new) - 1
        pick = order[head]
        return a[pick], None if b is None else b[pick], np.diff(np.r_[head, len(a)]) > 1, of

    def ask(self, part: int, level: int, alive: np.ndarray, buckets: int) -> pa.Table:
        """The candidates' keys for the buckets, and the candidates themselves for the part's next turn."""
        a, b, *_ = self.keys(level, np.flatnonzero(alive))
        rows = [(part, level, buckets + part, np.packbits(alive).tobytes())]
        for k, i, j in R.spans_of(R.bucket_of(a, buckets)):
            if b is None:
                wide = self.width
                data = a[i:j].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()
            else:
                wide, data = 16, a[i:j].tobytes() + b[i:j].tobytes()
            rows.append((part, level, k, bytes([wide]) + data))
        return R.messages(rows)

    def hear(self, part: int, level: int, heard: pa.Table, buckets: int) -> np.ndarray:
        """The starts of repeated windows at a level."""
        got = R.replies(heard)
        n = max(0, len(self.doc) - self.sizes[level] + 1)
        repeated = np.unpackbits(np.frombuffer(got[level, buckets + part], np.uint8), count=n).astype(bool)
        at = np.flatnonzero(repeated)
        a, _, twice, of = self.keys(level, at)
        (found,) = R.bits(got, level, R.bucket_of(a, buckets))
        repeated[at] = (found | twice)[of]
        return repeated


def ordered(table: pa.Table) -> pa.Table:
    """A part's rows in an order of their own: a shuffle may deliver them differently in each turn."""
    return table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


def answer(buckets: int):
    def act(table: pa.Table) -> pa.Table:
        """For one bucket: one bit a sent key, set if another part sent the same. Messages of a part to itself go back as they are."""
        if table["bucket"][0].as_py() >= buckets:
            return table.select(R.MESSAGE_ARROW.names).cast(R.MESSAGE_ARROW)
        sent = [np.frombuffer(x, dtype=np.uint8) for x in table["payload"].to_pylist()]
        level, wide = table["level"][0].as_py(), int(sent[0][0])
        size = [(len(x) - 1) // wide for x in sent]
        if wide == 16:
            a = np.concatenate([x[1 : 1 + 8 * n].view(A.U64) for x, n in zip(sent, size, strict=True)])
            b = np.concatenate([x[1 + 8 * n :].view(A.U64) for x, n in zip(sent, size, strict=True)])
        else:
            full = np.zeros((sum(size), 8), np.uint8)
            full[:, :wide] = np.concatenate([x[1:] for x in sent]).reshape(-1, wide)
            a, b = full.view(">u8").ravel().astype(A.U64), None
        order, new = _order(a, b)
        shared = np.empty(len(a), dtype=bool)
        shared[order] = (np.diff(np.r_[np.flatnonzero(new), len(a)]) > 1)[np.cumsum(new) - 1]
        parts, bucket = table["part"].to_pylist(), table["bucket"][0].as_py()
        return R.messages([(p, level, bucket, np.packbits(x).tobytes()) for p, x in zip(parts, np.split(shared, np.cumsum(size)[:-1]), strict=True)])

    return act


def substring_dedup(docs: DataFrame, window: int = 35, base: int = 9, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Documents without the words that a repeated window covers.

    Returns doc_id, n_words, n_removed and kept_text (the kept words joined by one space), one
    row for each row of docs. A word is a run of anything but space and \\t-\\r. Windows lie
    within one row and count as repeated if the same words start anywhere else, in this row or
    another; all copies go. Null text has no words (0, 0, ''). Fewer words than a window: all
    stay. Rows with the same or a null id count as rows of their own; the id is returned as it
    is. Other columns are ignored, whatever their names. An empty table gives no rows. A text
    is never cut: one task holds it whole, with about ten times its size in arrays.
    """
    if window < 1 or base < 1:
        raise ValueError("window and base must be at least 1")
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = R.text_bytes(texts, "text")
    parts = parts or R.part_count(total)
    buckets = max(12, parts // 4)
    dealt = R.deal(texts, parts)
    sizes, width = levels(base, window), key_bytes(total)

    def turn(level: int):
        """What a part does before a level is compared."""

        def first(table: pa.Table) -> pa.Table:
            table = ordered(table)
            part = Part(A.column(table, "text"), sizes, width)
            return part.ask(table["part"][0].as_py(), 0, part.candidates(0, None), buckets)

        def later(table: pa.Table, heard: pa.Table) -> pa.Table:
            table = ordered(table)
            part, name = Part(A.column(table, "text"), sizes, width), table["part"][0].as_py()
            return part.ask(name, level, part.candidates(level, part.hear(name, level - 1, heard, buckets)), buckets)

        return later if level else first

    def last(table: pa.Table, heard: pa.Table) -> pa.Table:
        table = ordered(table)
        part = Part(A.column(table, "text"), sizes, width)
        repeated = part.hear(table["part"][0].as_py(), len(sizes) - 1, heard, buckets)
        n, docs_n = len(part.start), len(part.off) - 1
        gone = A.covered(np.flatnonzero(repeated), window, n) if n else np.zeros(0, dtype=bool)
        buf, keep = part.buf.copy(), np.zeros(len(part.buf), dtype=bool)
        s, e, d = part.start[~gone], part.end[~gone], part.doc[~gone]
        if len(s):
            step = np.zeros(len(buf) + 1, np.int8)
            step[s] += 1
            step[e] -= 1
            keep = np.cumsum(step[:-1], dtype=np.int8) > 0
            gap = e[:-1][d[:-1] == d[1:]]
            buf[gap], keep[gap] = 32, True
        kept, at = A.gather(buf, part.off, keep)
        count = lambda x: pa.array(np.bincount(x, minlength=docs_n), pa.int64())
        return pa.table([A.column(table, "doc_id"), count(part.doc), count(part.doc[gone]), A.binaries(kept, at, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    heard = R.ask(dealt.groupBy("part").applyInArrow(turn(0), R.MESSAGE), buckets, answer(buckets))
    for level in range(1, len(sizes)):
        heard = R.ask(R.hear(dealt, [heard], parts, turn(level), R.MESSAGE), buckets, answer(buckets))
    return R.hear(dealt, [heard], parts, last, OUT)
