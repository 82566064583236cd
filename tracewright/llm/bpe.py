"""Byte-level BPE encoding and decoding with contiguous rank arrays (operator 6).

A text is cut at special tokens, then into pieces by the vocabulary's pattern. A piece that is
no token itself is held as an array of part boundaries beside an array of the ranks of
adjacent pairs; the least rank is found by a scan, its boundary deleted, and the ranks of its
two neighbours refreshed, until no pair has a rank. Pieces of one length are worked together,
a row each, and a worker keeps the pieces that it has met (a bounded number) for later texts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm._links import bounded_batches

#: Fixed value: the pattern that byte-level BPE vocabularies of this family split text by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points that newer Unicode tables class as letters or numbers and the
#: tokenizers library's tables don't; in a text with any beyond Latin-1 they are left out.
NOT_LETTERS = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c-\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a\\U00011db0-\\U00011ddb\\U00011df1"
    "\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff3\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20"
    "\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24"
    "\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5"
    "\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead"
    "\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
NOT_NUMBERS = "\\U00011de0-\\U00011de9\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ff4-\\U00016ff6"
NO_RANK = np.iinfo(np.int64).max
#: Pieces up to this many bytes are worked in rows together, and are kept.
SHORT = 48
KEEP = 1 << 18


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: printable Latin-1 for itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def latin(text: str) -> bool:
    """Whether all code points are below 256."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def kept_before(kept: dict[str, bytes], cut: list[list], new: set[str]) -> dict[str, bytes]:
    """What is kept of the pieces of these texts, before it is given up for new ones."""
    return {x: kept[x] for parts in cut for part in parts if not isinstance(part, int) for x in part if x not in new}


class Codec:
    """Encoder and decoder of one vocabulary file (the tokenizers library's JSON of a byte-level BPE)."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        letter = byte_letters()
        as_bytes = lambda s: bytes(letter[c] for c in s)
        ids = {as_bytes(k): v for k, v in model["vocab"].items()}
        pre = data.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or data.get("normalizer"):
            raise ValueError("only byte-level BPE without normaliser is supported")
        self.prefix_space = bool(pre.get("add_prefix_space"))
        self.whole_first = bool(model.get("ignore_merges"))
        self.size = max([*ids.values(), *(t["id"] for t in data.get("added_tokens", []))], default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for k, v in ids.items():
            self.bytes_of[v] = k
        # an added token stands for its own text in decoding
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        for text, k in self.special.items():
            self.bytes_of[k] = text.encode()
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        lett, num = f"[\\p{{L}}--[{NOT_LETTERS}]]", f"[\\p{{N}}--[{NOT_NUMBERS}]]"
        careful = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:(?!\s|{lett}|{num})(?s:.))").replace(r" ?\p{L}", f" ?{lett}").replace(r" ?\p{N}", f" ?{num}")
        self.careful = regex.compile("(?V1)" + careful)
        self.ids = ids
        self.byte_id = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        left, right, made = [], [], []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y = as_bytes(a), as_bytes(b)
            left.append(ids[x])
            right.append(ids[y])
            made.append(ids[x + y])
        pair = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        # the first of equal pairs counts
        self.pair, first = np.unique(pair, return_index=True)
        self.rank, self.made = first.astype(np.int64), np.array(made, np.int64)[first]
        self.rank_of = {int(p): (int(r), int(m)) for p, r, m in zip(self.pair, self.rank, self.made, strict=True)}
        self.kept: dict[str, bytes] = {}

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NO_RANK if none) and the token that it makes; -1 is no part."""
        if not len(self.pair):
            return np.full(a.shape, NO_RANK), np.zeros(a.shape, np.int64)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = (self.pair[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank[at], NO_RANK), self.made[at]

    def merge_rows(self, part: np.ndarray) -> list[bytes]:
        """Packed tokens of rows of equally many parts, all rows a step at a time."""
        n, width = part.shape
        part = part.copy()
        size = np.full(n, width)
        rank = np.full((n, width), NO_RANK)
        made = np.zeros((n, width), np.int64)
        rank[:, :-1], made[:, :-1] = self._ranks(part[:, :-1], part[:, 1:])
        live = np.arange(n)
        place = np.arange(width)
        while len(live):
            r = rank[live]
            at = r.argmin(axis=1)
            more = r[np.arange(len(live)), at] < NO_RANK
            live, at = live[more], at[more]
            if not len(live):
                break
            part[live, at] = made[live, at]
            # delete the boundary: everything behind moves up by one
            source = np.minimum(np.where(place > at[:, None], place + 1, place), width - 1)
            row = live[:, None]
            part[live] = part[row, source]
            rank[live] = rank[row, source]
            made[live] = made[row, source]
            size[live] -= 1
            part[live, size[live]] = -1
            rank[live, size[live] - 1] = NO_RANK
            # refresh the pairs that begin before and at the new part
            for shift in (-1, 0):
                i = at + shift
                ok = (i >= 0) & (i + 1 < size[live])
                rows, i = live[ok], i[ok]
                rank[rows, i], made[rows, i] = self._ranks(part[rows, i], part[rows, i + 1])
        flat, width = part.astype("<u4").tobytes(), 4 * width
        return [flat[i * width : i * width + 4 * k] for i, k in enumerate(size.tolist())]

    def merge_long(self, data: bytes) -> bytes:
        """One long piece: the same merges, with a heap in place of the scan."""
        import heapq

        part = self.byte_id[np.frombuffer(data, np.uint8)].tolist()
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i):
            j = after[i]
            if j < n:
                got = self.rank_of.get(part[i] << 32 | part[j])
                if got:
                    heapq.heappush(heap, (got[0], i, part[i], part[j], got[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if part[i] == a else n
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return np.array([x for x in part if x >= 0], "<u4").tobytes()

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed tokens of the pieces; short ones are kept while there is room."""
        out: dict[str, bytes] = {}
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode()
            whole = self.ids.get(data) if self.whole_first or len(data) == 1 else None
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(data) > SHORT:
                out[piece] = self.merge_long(data)
            else:
                by_size.setdefault(len(data), []).append((piece, data))
        for size, group in by_size.items():
            for a in range(0, len(group), 20_000):
                some = group[a : a + 20_000]
                raw = np.frombuffer(b"".join(d for _, d in some), np.uint8).reshape(len(some), size)
                out.update(zip((p for p, _ in some), self.merge_rows(self.byte_id[raw]), strict=True))
        room = KEEP - len(self.kept)
        if room < len(out):
            self.kept.clear()
            room = KEEP
        self.kept.update((p, t) for p, t in list(out.items())[:room] if len(p) <= SHORT)
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        cut: list[list] = []
        new: set[str] = set()
        kept = self.kept
        for text in texts:
            parts = []
            for piece in self.split.split(text) if self.split else [text]:
                if piece in self.special:
                    parts.append(self.special[piece])
                elif piece:
                    if self.prefix_space and not piece.startswith(" "):
                        piece = " " + piece
                    found = (self.pattern if latin(piece) else self.careful).findall(piece)
                    parts.append(found)
                    new.update(x for x in set(found) if x not in kept)
            cut.append(parts)
        more = kept_before(kept, cut, new) if len(new) + len(kept) > KEEP else {}
        more |= self.learn(new) if new else {}
        kept = self.kept
        out = []
        for parts in cut:
            ids: list[bytes] = []
            for part in parts:
                if isinstance(part, int):
                    ids.append(part.to_bytes(4, "little"))
                else:
                    ids += [kept[x] if x in kept else more[x] for x in part]
            out.append(np.frombuffer(b"".join(ids), "<u4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of the tokens; bytes that are no UTF-8 become U+FFFD."""
        of = self.bytes_of
        return b"".join([of[k] for k in ids.tolist()]).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """One codec a worker and vocabulary."""
    if spec not in _codecs:
        _codecs[spec] = Codec(spec)
    return _codecs[spec]


#: Characters of text that are encoded together.
BATCH_CHARS = 1 << 20


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers) and decoded of each row.

    vocabulary: the text of a byte-level BPE vocabulary file (at most 64 MB), which goes to the
    workers as a broadcast. Special tokens in a text become their ids; none are added. Null
    text is empty: no tokens. Repeated rows and null ids are encoded like any others; other
    columns are ignored, whatever their names. An empty table gives no rows.
    """
    if len(vocabulary) > 64 << 20:
        raise ValueError("the vocabulary is over 64 MB")
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = codec(shared.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            a = 0
            while a < len(texts):
                b, n = a, 0
                while b < len(texts) and (b == a or n + len(texts[b]) <= BATCH_CHARS):
                    n += len(texts[b])
                    b += 1
                ids = engine.encode_batch(texts[a:b])
                back = [engine.decode(x) for x in ids] if decode else [None] * len(ids)
                count = pa.array([len(x) for x in ids], pa.int64())
                packed = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), count, packed, pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])
                a = b
        # a worker may stay for other stages, which need its memory
        engine.kept.clear()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(act, "doc_id long, n_tokens long, ids binary, decoded string")
