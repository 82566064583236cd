"""Vectorised text primitives over one Arrow batch: words, rolling hashes, minimisers.

All functions work on whole batches with numpy; none keeps state between calls, so a
task that is run again after an executor is lost gives the same arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE2 = 0xC2B2AE3D27D4EB4F | 1
MASK = (1 << 64) - 1

#: The separators of a word: space, tab, line feed, vertical tab, form feed, return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: One random-looking 64-bit value a byte value; made from a rule, so that all workers agree.
TABLE = mix((np.arange(256, dtype=U64) + U64(1)) * U64(BASE))


def column(table: pa.Table, name: str) -> pa.Array:
    got = table.column(name)
    return got.combine_chunks() if got.num_chunks != 1 else got.chunk(0)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in one array, and where each text starts (one more for the end); null is empty."""
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, at, data = texts.buffers()
    off = np.frombuffer(at, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def ids(values: pa.Array, null: int = 2**63 - 1) -> np.ndarray:
    """Integer ids; a null id counts as the largest."""
    return pc.fill_null(values.cast(pa.int64()), null).to_numpy(zero_copy_only=False)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word; no word crosses documents."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    edge[-1] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


#: ASCII characters that are no letter, digit or white space.
MARK = np.zeros(256, dtype=bool)
MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def bare(raw: np.ndarray, start: np.ndarray, end: np.ndarray, depth: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Words without up to `depth` marks at either end."""
    s, e = start.copy(), end.copy()
    if len(raw):
        for _ in range(depth):
            s += (e > s) & MARK[raw[np.minimum(s, len(raw) - 1)]]
            e -= (e > s) & MARK[raw[np.maximum(e - 1, 0)]]
    return s, e


def slices(batch: pa.RecordBatch, name: str, most: int):
    """The batch in slices of about `most` bytes of the named text column, one row at least."""
    at, texts = 0, batch.column(batch.schema.get_field_index(name))
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(size)
    while at < batch.num_rows:
        done = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to


#: Words of more bytes are hashed one by one.
LONG = 64
#: The lower bytes of a 64-bit value, by their number.
LOWER_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = BASE) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight at a time, mixed after each; of long words by XXH3.

    Hashes of two seeds are independent. Words of eight bytes or less and one length never share a hash.
    """
    size = end - start
    out = mix(size.astype(U64) * U64(BASE2) + U64(seed))
    if not len(start):
        return out
    wide = np.zeros(len(buf) + 8, np.uint8)
    wide[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", wide, strides=(1,))
    step = 1 << 17
    for a in range(0, len(start), step):
        s, n, h = start[a : a + step], size[a : a + step], out[a : a + step]
        live = np.flatnonzero(n <= LONG)
        done = 0
        while len(live):
            live = live[n[live] > done]
            lane = eight[s[live] + done] & LOWER_BYTES[np.minimum(n[live] - done, 8)]
            h[live] = mix(h[live] * U64(BASE) + lane)
            done += 8
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(buf[start[k] : end[k]].tobytes(), seed)
    return out


def rolling(h: np.ndarray, size: int, base: int = BASE) -> np.ndarray:
    """The hash of every run of `size` values, joined from runs of doubled lengths."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    done, length, run, width, left = None, 0, h, 1, size
    while left:
        if left & 1:
            if done is None:
                done, length = run, width
            else:
                m = min(len(done), len(run) - length)
                done = done[:m] * U64(pow(base, width, 1 << 64)) + run[length : length + m]
                length += width
        left >>= 1
        if left:
            run = run[:-width] * U64(pow(base, width, 1 << 64)) + run[width:]
            width *= 2
    return mix(done[:n] + U64(size))


#: Values that stay in a core's cache.
CHUNK = 1 << 15
PLACE = U64(0xFFFF)


def leftmost_min(h: np.ndarray, count: int) -> np.ndarray:
    """Index of the leftmost least value (by its upper 48 bits) among each `count` consecutive ones, by doubling.

    The place in a chunk takes the lower 16 bits, so that one minimum finds value and place.
    """
    n = len(h) - count + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if count > CHUNK:
        raise ValueError(f"at most {CHUNK} values can be compared")
    out = np.empty(n, np.int64)
    place = np.arange(CHUNK + count, dtype=U64)
    for a in range(0, n, CHUNK):
        m = min(CHUNK, n - a)
        best = h[a : a + m + count - 1] & ~PLACE
        best |= place[: len(best)]
        width = 1
        while width * 2 <= count:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if width < count:
            best = np.minimum(best[:m], best[count - width : count - width + m])
        out[a : a + m] = (best[:m] & PLACE).astype(np.int64)
        out[a : a + m] += a
    return out


def rolling_bytes(buf: np.ndarray, size: int) -> np.ndarray:
    """rolling() over the table's values of bytes, a chunk at a time."""
    n = len(buf) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    for a in range(0, n, CHUNK):
        m = min(CHUNK, n - a)
        out[a : a + m] = rolling(TABLE[buf[a : a + m + size - 1]], size)
    return out


def packed_rows(buf: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Segments as rows of 64-bit words: two bytes of length, the bytes, zeros to the end."""
    cells = -(-(width + 2) // 8)
    out = np.zeros((len(start), cells * 8), np.uint8)
    if len(start):
        place, step = np.arange(width), max(1, (1 << 21) // width)
        for a in range(0, len(start), step):
            s, n = start[a : a + step, None], size[a : a + step, None]
            out[a : a + step, 2 : 2 + width] = buf[np.minimum(s + place, len(buf) - 1)] * (place < n)
        out[:, 0], out[:, 1] = size >> 8, size & 255
    return out.view(U64)


def row_hashes(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), U64)
    for k in range(rows.shape[1]):
        h = (h ^ rows[:, k]) * U64(BASE)
        h ^= h >> U64(29)
    return mix(h)


def distinct_rows(rows: np.ndarray, group: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts rows by group and puts equal rows together, and for each place in it whether a new distinct (group, row) begins.

    group: less than 2**bits. Rows are ordered by hash; where two differ under one hash, by their bytes.
    """
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, dtype=bool)
    key = (group.astype(U64) << U64(64 - bits)) | (row_hashes(rows) >> U64(bits)) if bits else row_hashes(rows)
    order = np.argsort(key)

    def fresh(order):
        new = np.ones(len(order), dtype=bool)
        new[1:] = key[order][1:] != key[order][:-1]
        same = np.flatnonzero(~new)
        return new, same, (rows[order[same]] == rows[order[same - 1]]).all(axis=1)

    new, same, equal = fresh(order)
    if not equal.all():
        order = np.lexsort([*(rows[:, k] for k in range(rows.shape[1])), key])
        new, same, equal = fresh(order)
        new[same] = ~equal
    return order, new


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of `size` places that begins at one of the starts."""
    ends = np.minimum(starts + size, n)
    step = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(step[:-1]) > 0


def gather(buf: np.ndarray, off: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept bytes, and where each document's begin."""
    upto = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(keep, out=upto[1:])
    return buf[keep], upto[off]


def binaries(buf: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Slices of one buffer as an Arrow array of binary or string."""
    if len(buf) >= 2**31:
        data = buf.tobytes()
        return pa.array([data[a:b] for a, b in zip(off[:-1], off[1:])], type=pa.large_binary())
    at = pa.py_buffer(off.astype(np.int32).tobytes())
    return pa.Array.from_buffers(kind, len(off) - 1, [None, at, pa.py_buffer(np.ascontiguousarray(buf).tobytes())])
