"""Suffix-array dedup by longest-previous-factor arrays (operator 7).

One suffix array over all texts can't be spread over a cluster, and need not be: equal
windows of `length` bytes have the same witness, the least-hashed run of `GRAM` bytes in
them, so they meet in the bucket of that witness. A first round of keys tells each part which
witnesses other documents have too; only the segments around those are sent on. A bucket
puts the suffixes of its segments in order, with the longest common prefix of neighbours, and
finds each one's previous and next place of a smaller document: the longer of the prefixes
shared with those two is its longest previous factor. A window whose factor reaches `length`
also starts in an earlier document, and goes; the first copy stays. Suffixes whose window's
hash is alone in the bucket can't reach `length` and are left out of the arrays.

A witness with many different surroundings (a line that a third of the documents hold) would
gather them all in one bucket. Such witnesses are marked in the first round, and their
windows are sent singly, to buckets by their own hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import _arrays as A
from tracewright.llm import _rounds as R
from tracewright.llm._links import bounded_batches

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

GRAM = 20
#: A part marks a witness that it finds with more surroundings than this.
MANY = 4


#: Rounds of pointer jumps before what is left is found by one pass with a stack.
JUMPS = 48


def suffix_order(text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that begin at the places, cut at `length` bytes, and the LCP of each with the one before it.

    Sorted by eight bytes, and ties by the next eight. text must go on for `length` bytes behind each place.
    """
    n = len(at)
    wide = np.zeros(len(text) + 8, np.uint8)
    wide[: len(text)] = text
    eight = np.ndarray((len(text) + 1,), ">u8", wide, strides=(1,))

    def word(k: int, some: np.ndarray) -> np.ndarray:
        """The bytes from 8k on of some suffixes; those behind `length` count as zero."""
        left = min(8, length - 8 * k)
        return eight[at[some] + 8 * k].astype(A.U64) >> A.U64(64 - 8 * left)

    order, lcp = np.arange(n), np.zeros(n, np.int64)
    tied, group = np.arange(n), np.zeros(n, np.int64)
    for k in range(-(-length // 8)):
        if not len(tied):
            break
        value = word(k, order[tied])
        inner = np.lexsort((value, group)) if k else np.argsort(value, kind="stable")
        order[tied] = order[tied][inner]
        value = value[inner]
        far = np.ones(len(tied), dtype=bool)
        far[1:] = group[1:] != group[:-1]
        x = np.r_[A.U64(0), value[1:] ^ value[:-1]]
        fresh = far | (x != 0)
        # neighbours of one group that differ here share all bytes before and the equal ones of this word
        cut = np.flatnonzero(fresh & ~far)
        left = min(8, length - 8 * k)
        same = left - 1 - np.floor(np.log2(np.maximum(x[cut].astype(np.float64), 1.0))).astype(np.int64) // 8
        # a value close below a power of two may be rounded up to it
        same += (same < left) & ((x[cut] >> (A.U64(8) * np.clip(left - 1 - same, 0, 7).astype(A.U64))) == 0)
        lcp[tied[cut]] = 8 * k + same
        lcp[tied[~fresh]] = min(length, 8 * k + 8)
        name = np.cumsum(fresh) - 1
        more = (np.bincount(name) > 1)[name]
        tied, group = tied[more], name[more]
    return order, lcp


def _by_stack(value: list[int], lcp: list[int]) -> tuple[list[int], list[int]]:
    """previous_smaller in one pass; the stack holds places of rising values, and the least LCP since the one below."""
    place, shared, stack = [], [], []
    for i, v in enumerate(value):
        least = lcp[i]
        while stack and value[stack[-1]] >= v:
            least = min(least, shared[stack.pop()])
        place.append(stack[-1] if stack else -1)
        shared.append(least if stack else 0)
        stack.append(i)
    return place, shared


def previous_smaller(value: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one before it of a smaller value (-1 if none), and the LCP of the two (0 if none).

    A place that is not smaller hands on its own answer so far; the few that need many such jumps are found with a stack.
    """
    place, shared = np.arange(len(value)) - 1, lcp.copy()
    live = np.flatnonzero(np.r_[False, value[:-1] >= value[1:]])
    for _ in range(JUMPS):
        if not len(live):
            break
        at = place[live]
        shared[live], place[live] = np.minimum(shared[live], shared[at]), place[at]
        live = live[place[live] >= 0]
        live = live[value[place[live]] >= value[live]]
    if len(live):
        place, shared = (np.array(x, np.int64) for x in _by_stack(value.tolist(), lcp.tolist()))
    return place, np.where(place >= 0, shared, 0)


def longest_previous(text: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """The longest previous factor of each suffix, cut at `length`: the most bytes that it shares with one of a smaller document."""
    out = np.zeros(len(at), np.int64)
    if len(at):
        order, lcp = suffix_order(text, at, length)
        mine = doc[order]
        _, before = previous_smaller(mine, lcp)
        _, after = previous_smaller(mine[::-1], np.r_[0, lcp[1:][::-1]])
        out[order] = np.maximum(before, after[::-1])
    return out


def meeting(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The suffixes whose window's hash is not alone."""
    h = A.rolling_bytes(text, length)[at]
    order = np.argsort(h)
    new = np.ones(len(h) + 1, dtype=bool)
    new[1:-1] = h[order][1:] != h[order][:-1]
    return np.sort(order[~(new[:-1] & new[1:])])


class _Part:
    def __init__(self, table: pa.Table, length: int):
        self.length = length
        self.gram = min(GRAM, length)
        self.buf, self.off = A.flat(A.column(table, "text"))
        self.id = A.ids(A.column(table, "doc_id"))
        n = len(self.buf) - length + 1
        self.window = np.zeros(0, np.int64)
        if n > 0:
            inside = np.ones(len(self.buf) + 1, dtype=bool)
            cut = self.off[(self.off > 0) & (self.off < len(self.buf))]
            bad = np.zeros(len(self.buf) + 1, np.int32)
            np.add.at(bad, np.maximum(cut - length + 1, 0), 1)
            np.add.at(bad, cut, -1)
            inside = np.cumsum(bad[:-1]) == 0
            self.window = np.flatnonzero(inside[:n])
            h = A.rolling_bytes(self.buf, self.gram)
            mine = A.leftmost_min(h, length - self.gram + 1)[self.window]
            new = np.ones(len(mine), dtype=bool)
            new[1:] = (mine[1:] != mine[:-1]) | (self.window[1:] != self.window[:-1] + 1)
            first = np.flatnonzero(new)
            self.start = self.window[first]
            self.size = np.diff(np.r_[first, len(mine)]) + length - 1
            self.key = A.mix(h[mine[first]])  # least hashes are small ones; mixed, they fill all buckets alike
            self.around = A.mix(h[self.start]) ^ h[self.start + self.size - self.gram]
            self.doc = np.searchsorted(self.off, self.start, "right") - 1
        else:
            self.start = self.size = self.doc = np.zeros(0, np.int64)
            self.key = self.around = np.zeros(0, A.U64)
        self.owner = self.id[self.doc]

    def keys(self, surroundings: bool = False):
        """Distinct witnesses; whether two documents of this part hold each; whether with many surroundings (if asked); each segment's witness."""
        if not len(self.key):
            none = np.zeros(0, dtype=bool)
            return self.key, none, none, np.zeros(0, np.int64)
        order = np.argsort(self.key)
        key, owner = self.key[order], self.owner[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        head, group = np.flatnonzero(new), np.cumsum(new) - 1
        of = np.empty(len(key), np.int64)
        of[order] = group
        several = np.minimum.reduceat(owner, head) < np.maximum.reduceat(owner, head)
        many = np.zeros(len(head), dtype=bool)
        if surroundings:
            often = np.flatnonzero((np.diff(np.r_[head, len(key)]) > MANY)[group])
            if len(often):
                pair = np.unique(np.stack([group[often].astype(A.U64), self.around[order[often]]]), axis=1)[0].astype(np.int64)
                many = np.bincount(pair, minlength=len(head)) > MANY
        return key[head], several, many, of

    def segments(self, got: dict, buckets: int):
        """What is sent: distinct segments sorted by bucket with their least owner; and for each kept segment its place there, start and owner."""
        key, several, _, of = self.keys()
        found, hot = R.bits(got, 0, R.bucket_of(key, buckets), planes=2)
        use, single = (found | several)[of], hot[of]
        whole = np.flatnonzero(use & ~single)
        start, size, where, owner = self.start[whole], self.size[whole], R.bucket_of(self.key[whole], buckets), self.owner[whole]
        split = np.flatnonzero(use & single)
        if len(split):
            n = self.size[split] - self.length + 1
            head = np.cumsum(n) - n
            s = np.repeat(self.start[split], n) + np.arange(int(n.sum())) - np.repeat(head, n)
            h = A.rolling_bytes(self.buf, self.length)[s]
            start, size = np.r_[start, s], np.r_[size, np.full(len(s), self.length)]
            where, owner = np.r_[where, R.bucket_of(h, buckets)], np.r_[owner, np.repeat(self.owner[split], n)]
        rows = A.packed_rows(self.buf, start, size, 2 * self.length - self.gram)
        order, new = A.distinct_rows(rows, where, max(1, buckets.bit_length()))
        head, place = np.flatnonzero(new), np.empty(len(rows), np.int64)
        place[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(owner[order], head) if len(head) else owner
        return rows[order[head]], where[order[head]], least, place, start, size, owner


def _sizes(rows: np.ndarray) -> np.ndarray:
    flat = rows.view(np.uint8)
    return (flat[:, 0].astype(np.int64) << 8) | flat[:, 1]


def _pack(rows: np.ndarray, least: np.ndarray, width: int) -> bytes:
    """Segments and owners of one bucket, compressed: count, width, lengths, owners, bytes."""
    size = _sizes(rows)
    data = rows.view(np.uint8)[:, 2 : 2 + width][np.arange(width) < size[:, None]]
    return zstandard.ZstdCompressor(level=3).compress(b"".join((np.uint32(len(rows)).tobytes(), np.uint32(width).tobytes(), size.astype(np.uint16).tobytes(), least.astype(np.int64).tobytes(), data.tobytes())))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    n, width = (int(x) for x in raw[:8].view(np.uint32))
    size = raw[8 : 8 + 2 * n].view(np.uint16).astype(np.int64)
    least = raw[8 + 2 * n : 8 + 10 * n].copy().view(np.int64)
    return A.packed_rows(raw[8 + 10 * n :], np.cumsum(size) - size, size, width), least


def answer_keys(table: pa.Table) -> pa.Table:
    """For one bucket: a bit for each sent key if another part has it, then a bit if it is to be split."""
    sent = [np.frombuffer(x, dtype=np.uint8) for x in table["payload"].to_pylist()]
    size = [int(x[:4].view(np.uint32)[0]) for x in sent]
    key = np.concatenate([x[4 : 4 + 8 * n].view(A.U64) for x, n in zip(sent, size, strict=True)])
    many = np.concatenate([np.unpackbits(x[4 + 8 * n :], count=n) for x, n in zip(sent, size, strict=True)]).astype(np.int64)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[order][1:] != key[order][:-1]
    head, group = np.flatnonzero(new), np.cumsum(new) - 1
    shared, hot = np.empty(len(key), dtype=bool), np.empty(len(key), dtype=bool)
    shared[order] = (np.diff(np.r_[head, len(key)]) > 1)[group]
    hot[order] = (np.add.reduceat(many[order], head) > 0)[group]
    cut = np.cumsum(size)[:-1]
    bucket = table["bucket"][0].as_py()
    return R.messages([(p, 0, bucket, np.packbits(x).tobytes() + np.packbits(y).tobytes()) for p, x, y in zip(table["part"].to_pylist(), np.split(shared, cut), np.split(hot, cut), strict=True)])


def answer_segments(length: int):
    def act(table: pa.Table) -> pa.Table:
        """For one bucket: a bit for each window of each sent segment, set if it also starts in a document before the segment's least owner."""
        sent = [_unpack(x) for x in table["payload"].to_pylist()]
        count = [len(x) for x, _ in sent]
        rows, least = np.concatenate([x for x, _ in sent]), np.concatenate([y for _, y in sent])
        # equal segments of several parts stand once, with their least owner
        order, new = A.distinct_rows(rows, np.zeros(len(rows), np.int64), 0)
        head, place = np.flatnonzero(new), np.empty(len(rows), np.int64)
        place[order] = np.cumsum(new) - 1
        single, owner = rows[order[head]], np.minimum.reduceat(least[order], head)
        n = _sizes(single) - length + 1
        first = np.cumsum(n) - n
        at = np.repeat(np.arange(len(single)) * single.shape[1] * 8 + 2, n) + np.arange(int(n.sum())) - np.repeat(first, n)
        text, doc, factor = single.view(np.uint8).ravel(), np.repeat(owner, n), np.zeros(len(at), np.int64)
        met = meeting(text, at, length)
        factor[met] = longest_previous(text, at[met], doc[met], length)
        # each part's segment against its own least owner
        per = n[place]
        head2 = np.cumsum(per) - per
        which = np.repeat(first[place], per) + np.arange(int(per.sum())) - np.repeat(head2, per)
        bit = (factor[which] >= length) | (doc[which] < np.repeat(least, per))
        cut = np.add.reduceat(per, np.r_[0, np.cumsum(count)[:-1]]).cumsum()[:-1]
        bucket = table["bucket"][0].as_py()
        return R.messages([(p, 1, bucket, np.packbits(x).tobytes()) for p, x in zip(table["part"].to_pylist(), np.split(bit, cut), strict=True)])

    return act


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Documents without the bytes of later copies of `length`-byte strings.

    Returns doc_id, n_bytes, n_removed, n_spans and kept (the remaining UTF-8 bytes, which may
    cut a code point), one row for each row of docs. A byte goes if a string of `length` bytes
    over it also starts in a document with a smaller id; the first document keeps its copy.
    Matches lie within one row's text. Null text is empty (0, 0, 0, empty). Shorter texts stay
    whole. Rows with the same id are not earlier than each other; a null id counts as the
    largest, and nulls not earlier than each other. Other columns are ignored, whatever their
    names. An empty table gives no rows. A text is never cut: one task holds it whole, with
    about thirty times its size in arrays.
    """
    if not 1 <= length <= 16000:
        raise ValueError("length must be from 1 to 16000 bytes")
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = parts or R.part_count(R.text_bytes(texts, "text"))
    buckets = parts
    # rows of one id may sit in several parts: owners, not parts, decide in the end
    dealt = R.deal(texts, parts)

    def first(table: pa.Table) -> pa.Table:
        key, _, many, _ = _Part(table, length).keys(surroundings=True)
        mine = table["part"][0].as_py()
        return R.messages([(mine, 0, k, np.uint32(j - i).tobytes() + key[i:j].tobytes() + np.packbits(many[i:j]).tobytes()) for k, i, j in R.spans_of(R.bucket_of(key, buckets))])

    def second(table: pa.Table, heard: pa.Table) -> pa.Table:
        if not table.num_rows:
            return R.messages([])
        rows, where, least, *_ = _Part(table, length).segments(R.replies(heard), buckets)
        mine = table["part"][0].as_py()
        return R.messages([(mine, 1, k, _pack(rows[i:j], least[i:j], 2 * length - min(GRAM, length))) for k, i, j in R.spans_of(where)])

    def last(table: pa.Table, heard: pa.Table) -> pa.Table:
        part, got = _Part(table, length), R.replies(heard)
        rows, where, least, place, start, size, owner = part.segments(got, buckets)
        n = len(part.buf)
        gone = np.zeros(n, dtype=bool)
        if len(rows):
            per = _sizes(rows) - length + 1
            head = np.cumsum(per) - per
            earlier = np.zeros(int(per.sum()), dtype=bool)
            for k, i, j in R.spans_of(where):
                a, b = head[i], head[j - 1] + per[j - 1]
                earlier[a:b] = np.unpackbits(np.frombuffer(got[1, k], dtype=np.uint8), count=int(b - a)).astype(bool)
            mine = per[place]
            first_bit = np.cumsum(mine) - mine
            step = np.arange(int(mine.sum())) - np.repeat(first_bit, mine)
            bit = earlier[np.repeat(head[place], mine) + step] | np.repeat(least[place] < owner, mine)
            gone = A.covered((np.repeat(start, mine) + step)[bit], length, n)
        kept, at = A.gather(part.buf, part.off, ~gone)
        edge = np.zeros(n + 1, dtype=bool)
        edge[part.off] = True
        begins = gone.copy()
        begins[1:] &= ~gone[:-1] | edge[1:-1]
        upto = lambda x: np.diff(np.r_[0, np.cumsum(x)][part.off])
        return pa.table([A.column(table, "doc_id"), pa.array(np.diff(part.off)), pa.array(upto(gone)), pa.array(upto(begins)), A.binaries(kept, at, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    heard = [R.ask(dealt.groupBy("part").applyInArrow(first, R.MESSAGE), buckets, answer_keys)]
    heard.append(R.ask(R.hear(dealt, heard, parts, second, R.MESSAGE), buckets, answer_segments(length)))
    return R.hear(dealt, heard, parts, last, OUT)
