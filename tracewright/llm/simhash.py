"""SimHash near-dedup with BK-trees (operator 3).

Fingerprints are collapsed to distinct ones, and these are dealt to shards by bits that close
fingerprints share. Each shard is a BK-tree: children keyed by their integer Hamming distance
to the parent, searched along the edges within the radius. The trees of all shards in a task
are built and searched together, a level at a time. A shard's tree grows with the corpus, so
it goes to the task that searches it instead of being broadcast. What a task finds is reduced
to a spanning forest; components are joined over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import _arrays as A
from tracewright.llm._links import bounded_batches, checkpointed, components, hot_join, shared_out, union

SEED = 42


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each run of `size` lower-cased words (A-Z only), joined by spaces; of all words if there are fewer."""
    words = text.lower().split()  # of bytes: ASCII letters, and the white space \t-\r and space
    if not words:
        return np.zeros(0, A.U64)
    line = b" ".join(words)
    n = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(n + 1) - n - 1
    end = start + n
    k = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    a, b = start[:k].tolist(), end[len(words) - k :].tolist()
    return np.fromiter((digest(line[i:j], SEED) for i, j in zip(a, b, strict=True)), A.U64, k)


def fingerprint(h: np.ndarray) -> int:
    """Bit i is set if over half of the hashes have it; zero for no hashes. Signed, as Spark holds it."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        part = h[a : a + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


class Forest:
    """BK-trees in arrays: value, root, parent and distance to the parent of each node; tree gives each value's tree."""

    def __init__(self, value: np.ndarray, tree: np.ndarray):
        self.value = value
        n = len(value)
        self.parent, self.edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.root = np.empty(n, np.int64)
        rest, group = np.arange(n), tree
        top = True
        while len(rest):
            order = np.argsort(group, kind="stable")
            rest, group = rest[order], group[order]
            new = np.ones(len(rest), dtype=bool)
            new[1:] = group[1:] != group[:-1]
            node = rest[np.maximum.accumulate(np.where(new, np.arange(len(rest)), 0))]
            if top:
                self.root[rest] = node
                top = False
            rest, node = rest[~new], node[~new]
            far = np.bitwise_count(value[rest] ^ value[node]).astype(np.int64)
            self.parent[rest], self.edge[rest] = node, far
            group = node * 128 + far
        child = np.flatnonzero(self.parent >= 0)
        key = self.parent[child] * 128 + self.edge[child]
        order = np.argsort(key, kind="stable")
        self.child, self.key = child[order], key[order]

    def within(self, query: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) of places of one tree at the radius or less, a level at a time; node is not the query."""
        node = self.root[query]
        while len(query):
            far = np.bitwise_count(self.value[query] ^ self.value[node]).astype(np.int64)
            hit = (far <= radius) & (query != node)
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.key, node * 128 + np.maximum(far - radius, 0))
            high = np.searchsorted(self.key, node * 128 + np.minimum(far + radius, 64), "right")
            n = high - low
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            query, node = np.repeat(query, n), self.child[at]

    def blocks(self, most: int = 1 << 21) -> Iterator[np.ndarray]:
        """All places, in blocks whose trees make bounded frontiers."""
        size = np.bincount(self.root, minlength=len(self.root))[self.root]
        load = np.cumsum(size) // most
        cut = np.flatnonzero(np.diff(load)) + 1
        yield from np.split(np.arange(len(self.value)), cut)


def trees(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """One number for each distinct combination of the columns."""
    out = np.zeros(table.num_rows, np.int64)
    for name in names:
        _, code = np.unique(A.column(table, name).to_numpy(), return_inverse=True)
        _, out = np.unique(out * (code.max() + 1) + code, return_inverse=True)
    return out


def masks(radius: int, blocks: int) -> list[int]:
    """Bit masks such that two 64-bit values at the radius or less agree on all bits of one of them."""
    if not radius < blocks <= 64:
        raise ValueError("blocks must be over the radius")
    edge = [round(64 * k / blocks) for k in range(blocks + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edge, edge[1:], strict=False)]
    return [sum(one[k] for k in some) for some in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks_for(count: int, radius: int) -> int:
    """So many blocks that a shard of a corpus of evenly spread fingerprints stays small; any number finds all links."""
    blocks = radius + 1
    while blocks < 64 and count > 256 << (64 * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp of each row."""

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fp = np.fromiter((fingerprint(shingle_hashes((x.as_py() or "").encode(), shingle)) for x in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(act, "doc_id long, fp long")


def fingerprint_links(fps: DataFrame, radius: int, blocks: int | None = None, block_rows: int = 20_000) -> DataFrame:
    """Links (a, b) between the distinct values of fp that give the same components as all pairs at the radius or less."""
    count = fps.count()
    use = masks(radius, blocks or blocks_for(count, radius))
    shards = max(96, count * len(use) // 60_000)
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(use)))).alias("x")).select("fp", "x.*")
    cut = shared_out(keyed, ["mask", "bits"], F.xxhash64("fp"), block_rows)

    def act(table: pa.Table) -> pa.Table:
        value = A.column(table, "fp").to_numpy().view(A.U64)
        forest, label = Forest(value, trees(table, ("mask", "bits", "lo", "hi"))), np.arange(len(value))
        for some in forest.blocks():
            for a, b in forest.within(some, radius):
                label = union(label, a, b)
        child = np.flatnonzero(label != np.arange(len(label)))
        return pa.table([pa.array(value[child].view(np.int64)), pa.array(value[label[child]].view(np.int64))], ["a", "b"])

    shard = F.pmod(F.xxhash64("mask", "bits", "lo", "hi"), F.lit(shards).cast("long"))
    return cut.withColumn("shard", shard).groupBy("shard").applyInArrow(act, "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (64 bits, signed), component_id and n_links of each row.

    Fingerprints of whole texts link at `radius` or fewer differing bits; component_id is the
    smallest doc_id that links reach. n_links counts the rows with the same fingerprint besides
    the row itself. Null and empty texts have the fingerprint zero, linked like any other.
    Rows with a null id belong to components too; component_id is null only where no row of
    the component has an id. Repeated rows come out once each. Other columns are ignored,
    whatever their names. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    all_rows = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    each = checkpointed(all_rows.groupBy("fp").agg(F.min("doc_id").alias("first"), (F.count(F.lit(1)) - 1).alias("n_links")))
    roots = components(fingerprint_links(each.select("fp"), radius))
    rooted = each.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "n_links", F.coalesce("root", "fp").alias("root"))
    rooted = checkpointed(rooted)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = checkpointed(hot_join(rooted, least, "root").select("fp", "component_id", "n_links"))
    return hot_join(all_rows, named, "fp").select("doc_id", "fp", "component_id", "n_links")
