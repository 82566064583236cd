"""The contracts of the queries, word for word, in plain Python over all rows."""

import hashlib
import re
import struct
from collections import Counter, defaultdict

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def op1(docs, window=35):
    words = {d: WORDS.findall(t or "") for d, t in docs}
    starts = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        yield d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def fingerprint(text, shingle=4):
    w = WORDS.findall((text or "").translate(LOWER))
    parts = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    bits = [0] * 64
    for p in parts:
        h = xxhash.xxh64(p.encode(), seed=42).intdigest()
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if bits[b] * 2 > len(parts)) if parts else 0


def op3(docs, radius=4):
    prints = [(d, fingerprint(t)) for d, t in docs]
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (d, a) in enumerate(prints):
        for e, b in prints[:k]:
            if (a ^ b).bit_count() <= radius:
                lo, hi = sorted((find(d), find(e)))
                root[hi] = lo
    for d, f in prints:
        yield d, f"{f:016x}", find(d)


def op5(docs, least=20, held=3):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    lines = {d: (t or "").split("\n") for d, t in docs}
    holders = defaultdict(set)
    for d, all_lines in lines.items():
        for line in all_lines:
            holders[key(line)].add(d)
    for d, all_lines in lines.items():
        kept = [x for x in all_lines if len(key(x)) < least or len(holders[key(x)]) < held or max(holders[key(x)]) == d]
        yield d, len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept))


def op6(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    for d, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        yield d, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t.decode(ids, skip_special_tokens=False))


def op7(docs, length=50):
    seen, out = {}, []
    for d, text in sorted(docs):
        b = (text or "").encode()
        gone = bytearray(len(b))
        own = []
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if seen.get(s, d) < d:
                gone[i : i + length] = b"\1" * length
            own.append(s)
        for s in own:
            seen.setdefault(s, d)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def op8(vectors, k=5):
    import math

    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q, a in whole.items():
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole.items() if i != q)[:k]
            for rank, (s, i) in enumerate(best, 1):
                yield q, rank, i, -s


KINDS = {
    "assign": re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def op9(docs):
    for d, text in docs:
        spans = []
        for order, (kind, rule) in enumerate(KINDS.items()):
            for m in rule.finditer(text or ""):
                if kind == "assign" and len(m[2]) >= 8 or kind == "access" and len(m[0]) >= 16 or kind == "hex" and len(m[0]) >= 32:
                    spans.append((m.start(), order, kind, m.end()))
        count = Counter(s[2] for s in spans)
        yield d, count["assign"], count["access"], count["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)))
