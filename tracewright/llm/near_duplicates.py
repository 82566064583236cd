"""Near-duplicates: SimHash BK-trees, verified, and an exact way for the links that they miss.

Equal texts are collapsed first; each text left is a node with the sorted set of its shingles
(40 bits of a hash each) in a written table. Nodes with the same least shingle meet in a
shard's BK-tree (operator 3's), and pairs within its radius are verified on their shingles.
That finds most links. What is left is looked for in groups of nodes that are not all joined
yet: first of those with another least hash in common, then of those that share a shingle of
their prefixes, as every similar pair does. Members without a possible partner, by size and
by counts of hashes, are dropped; the shingles of the rest alone are sent and verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import _arrays as A
from tracewright.llm._links import FEW_ROWS, bounded_batches, checkpointed, components, hot_join, remove, shared_out, small, table_folder
from tracewright.llm.simhash import Forest, fingerprint, shingle_hashes, trees

#: Bytes of a shingle's hash that are kept: two unlike shingles are taken for one with a chance of 2**-40.
WIDTH = 5
#: Nodes, and bytes of shingles, that a task holds at a time, on average.
SHARD_NODES, SHARD_BYTES = 2_000, 8 << 20
#: Texts whose shingles are made at a time, in bytes.
SLICE_BYTES = 4 << 20
#: Pairs of a query and a tree's node that are held at a time.
FRONTIER = 1 << 18
#: Least hashes of each set: by the first all nodes meet in trees, by the others those that are left.
KEYS = 5
SCHEMA = "node binary, first long, fp long, keys array<long>, spread binary, shingles binary"


def same_text(text: Column) -> Column:
    """128 bits that equal texts share; null is empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def packed(s: np.ndarray) -> bytes:
    return np.ascontiguousarray(s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]).tobytes()


def unpacked(values: pa.Array) -> list[np.ndarray]:
    """The sorted shingles of each text."""
    raw, off = A.flat(values)
    wide = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    wide[:, :WIDTH] = raw.reshape(-1, WIDTH)
    return np.split(wide.view("<u8").ravel(), (off[1:-1] // WIDTH)) if len(off) > 1 else []


def shingle_set(text: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of a text, whole and cut to WIDTH bytes, each sorted."""
    s = np.unique(shingle_hashes(text, size))
    return s, np.unique(s >> A.U64(64 - 8 * WIDTH))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets is `similarity` or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


class Label:
    """Union by place: top is each place's root, kept flat, the least place joined so far."""

    def __init__(self, top: np.ndarray):
        self.top = top

    def join(self, i: int, j: int) -> None:
        x, y = int(self.top[i]), int(self.top[j])
        if x != y:
            self.top[self.top == max(x, y)] = min(x, y)

    def link(self, a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], similarity: float, step: int = 2048) -> None:
        """Joins the similar ones among pairs; those joined by then are not compared."""
        for k in range(0, len(a), step):
            x, y = a[k : k + step], b[k : k + step]
            apart = self.top[x] != self.top[y]
            for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
                if self.top[i] != self.top[j] and similar(sets[i], sets[j], similarity):
                    self.join(i, j)

    def edges(self, name: np.ndarray) -> pa.Table:
        """One edge from each place to its root, by name."""
        child = np.flatnonzero(name != name[self.top])
        return pa.table([pa.array(name[child]), pa.array(name[self.top[child]])], ["a", "b"])


def spread_of(s: np.ndarray) -> np.ndarray:
    """How many hashes of a set have each value of their lower bits: of so many that a value has two to four."""
    values = 1 << max(5, min(13, (len(s) // 2).bit_length()))
    return np.bincount((s & A.U64(values - 1)).astype(np.int64), minlength=values).astype(np.uint16)


def _spread_bytes(s: np.ndarray) -> bytes:
    n = spread_of(s)
    return b"\1" + n.astype(np.uint8).tobytes() if n.max() < 256 else b"\2" + n.tobytes()


def _spreads(values: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8 if x[0] == 1 else np.uint16, offset=1).astype(np.uint16) for x in values.to_pylist()]


class Spreads:
    """The counts of a group's sets, side by side with those of half and twice as many values."""

    def __init__(self, each: list[np.ndarray]):
        self.bits = np.fromiter((len(x).bit_length() - 1 for x in each), np.int64, len(each))
        self.rows, self.place = {}, {}
        for b in np.unique(self.bits).tolist():
            mine = np.flatnonzero((self.bits == b) | (self.bits == b + 1))
            self.rows[b] = np.stack([each[i] if len(each[i]) == 1 << b else each[i][: 1 << b] + each[i][1 << b :] for i in mine.tolist()])
            self.place[b] = np.full(len(each), -1, np.int64)
            self.place[b][mine] = np.arange(len(mine))

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """What a set has in common with larger ones (up to twice its size) at most."""
        b = int(self.bits[i])
        rows, place = self.rows[b], self.place[b]
        return np.minimum(rows[place[others]], rows[place[i]]).sum(axis=1, dtype=np.int64)


def _reach(n: np.ndarray, similarity: float) -> np.ndarray:
    """For sizes in order: how many places each one's partners go on to."""
    return np.searchsorted(n, n / similarity + 1e-6, "right")


def _hopeful(most: np.ndarray, n: np.ndarray, m: int, similarity: float) -> np.ndarray:
    """Whether sets of n and m hashes with `most` in common at most can be similar."""
    return most * (1 + similarity) >= similarity * (n + m) - 1e-6


def _groups(group: np.ndarray, size: np.ndarray):
    """The places of each group, by size."""
    order = np.lexsort((size, group))
    yield from np.split(order, np.flatnonzero(np.diff(group[order])) + 1)


def verify(group: np.ndarray, sets: list[np.ndarray], label: Label, similarity: float) -> None:
    """Joins all that similar pairs of one group reach, but for pairs that size, counts or an earlier link rule out."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    for some in _groups(group, size):
        if (label.top[some] == label.top[some[0]]).all():
            continue
        n, spreads = size[some], Spreads([spread_of(sets[i]) for i in some.tolist()])
        upto = _reach(n, similarity)
        for k in range(len(some) - 1):
            rest = np.arange(k + 1, max(k + 1, int(upto[k])))
            rest = rest[label.top[some[rest]] != label.top[some[k]]]
            if len(rest):
                near = some[rest[_hopeful(spreads.shared(k, rest), n[rest], int(n[k]), similarity)]]
                label.link(np.full(len(near), some[k]), near, sets, similarity)


def with_partner(group: np.ndarray, root: np.ndarray, spread: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which places have a partner of another root in their group that size and counts leave."""
    out, size = np.zeros(len(group), dtype=bool), np.fromiter((int(x.sum(dtype=np.int64)) for x in spread), np.int64, len(spread))
    for some in _groups(group, size):
        if (root[some] == root[some[0]]).all():
            continue
        n, spreads = size[some], Spreads([spread[i] for i in some.tolist()])
        upto = _reach(n, similarity)
        for k in range(len(some) - 1):
            rest = np.arange(k + 1, max(k + 1, int(upto[k])))
            rest = rest[root[some[rest]] != root[some[k]]]
            if len(rest):
                near = rest[_hopeful(spreads.shared(k, rest), n[rest], int(n[k]), similarity)]
                out[some[near]] = True
                out[some[k]] |= len(near) > 0
    return out


def common_shingles(nodes: DataFrame, count: int, sample: int = 4096, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the nodes holds three times or more, sorted, and how often.

    They only order the shingles (prefix_of); any order finds all links, so the sample loses none.
    """

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in unpacked(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["h"])

    some = nodes.where(F.pmod(F.xxhash64("node"), F.lit(max(1, count // sample)).cast("long")) == 0).select("shingles")
    times = some.mapInArrow(act, "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(most).toArrow()
    h, n = A.column(times, "h").to_numpy().view(A.U64), A.column(times, "count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix_of(s: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a set, the rare ones before the common; sets at the similarity or more share one of them.

    They have similarity * n shingles in common at least, n the size of either one, so that not
    all of those can lie behind the first n - ceil(similarity * n) + 1 of each.
    """
    h, times = common
    seen = np.zeros(len(s), np.int64)
    if len(h):
        at = np.minimum(np.searchsorted(h, s), len(h) - 1)
        seen = np.where(h[at] == s, times[at], 0)
    return s[np.lexsort((s, seen))[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1]] if len(s) else s


def prefix_groups(nodes: DataFrame, similarity: float, count: int) -> DataFrame:
    """(grp, id): every two nodes that share a shingle of their prefixes are in a group; shingles of the same nodes make one group."""
    shared = nodes.sparkSession.sparkContext.broadcast(common_shingles(nodes, count))
    shards = max(24, count // SHARD_NODES)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [prefix_of(s, shared.value, similarity) for s in unpacked(batch.column(1))]
            if not parts:
                continue
            h = A.mix(np.concatenate(parts))
            # 32 bits of the hash and the shard: shingles that share them only make a group larger
            low, high = h.astype(np.uint32).view(np.int32), ((h >> A.U64(32)) % A.U64(shards)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in parts]))], ["shard", "key", "id"])

    def meet(table: pa.Table) -> pa.Table:
        key, node = A.column(table, "key").to_numpy(), A.column(table, "id").to_numpy()
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node = key[new], node[new]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[start, len(key)])
        name = np.repeat(np.add.reduceat(A.mix(node.view(A.U64) + A.U64(A.BASE)), start).view(np.int64), n)
        many = np.repeat(n > 1, n)
        name, node = name[many], node[many]
        order = np.lexsort((node, name))
        name, node = name[order], node[order]
        new = np.ones(len(name), dtype=bool)
        new[1:] = (name[1:] != name[:-1]) | (node[1:] != node[:-1])
        return pa.table([pa.array(name[new]), pa.array(node[new])], ["grp", "id"])

    keyed = nodes.select("id", "shingles").mapInArrow(spread, "shard int, key int, id long")
    return keyed.groupBy("shard").applyInArrow(meet, "grp long, id long").distinct()


def _one_each(rows: DataFrame) -> DataFrame:
    """node, first (the least doc_id) and text of each distinct text.

    Where no row is repeated and few are copies, the copies are told by their ids and no text
    is shuffled; else the texts are grouped.
    """
    pairs = checkpointed(rows.select("doc_id", "node").groupBy("doc_id", "node").count())
    copied = pairs.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("node", "first")
    copies = checkpointed(pairs.join(small(checkpointed(copied)), "node").where("doc_id <> first").select("doc_id", "node"))
    if pairs.where("count > 1").limit(1).count() == 0 and copies.count() <= FEW_ROWS:
        return rows.join(F.broadcast(copies), ["doc_id", "node"], "left_anti").select("node", F.col("doc_id").alias("first"), "text")
    return rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("text").alias("text"))


def _nodes(rows: DataFrame, shingle: int, path: str) -> DataFrame:
    """The table of nodes, written at the path: id, node, first, fp, keys (least hashes), spread and shingles."""

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, "text", SLICE_BYTES):
                fp, keys, spreads, sets = [], [], [], []
                for x in part.column(2):
                    s, cut = shingle_set((x.as_py() or "").encode(), shingle)
                    fp.append(fingerprint(s))
                    keys.append([int((s if k == 0 else A.mix(s + A.U64(k))).min().view(np.int64)) for k in range(KEYS)] if len(s) else [])
                    spreads.append(_spread_bytes(cut))
                    sets.append(packed(cut))
                made = [pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(spreads, pa.binary()), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], ["node", "first", "fp", "keys", "spread", "shingles"])

    _one_each(rows).mapInArrow(act, SCHEMA).withColumn("id", F.monotonically_increasing_id()).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _tree_links(nodes: DataFrame, shards: int, radius: int, similarity: float, block_rows: int) -> DataFrame:
    def link(table: pa.Table) -> pa.Table:
        sets, name = unpacked(A.column(table, "shingles")), A.column(table, "id").to_numpy()
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        forest, label = Forest(A.column(table, "fp").to_numpy().view(A.U64), trees(table, ("key", "lo", "hi"))), Label(np.arange(len(sets)))
        for some in forest.blocks(FRONTIER):
            for a, b in forest.within(some, radius):
                # sizes alone rule out many pairs
                near = (label.top[a] != label.top[b]) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9)
                label.link(a[near], b[near], sets, similarity)
        return label.edges(name)

    keyed = nodes.where("size(keys) > 0").select("id", "fp", F.get("keys", F.lit(0)).alias("key"), "shingles")
    cut = shared_out(keyed, ["key"], F.xxhash64("id"), block_rows)
    shard = F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(shards).cast("long"))
    return cut.withColumn("shard", shard).groupBy("shard").applyInArrow(link, "a long, b long")


def _group_links(nodes: DataFrame, groups: DataFrame, roots: DataFrame, similarity: float, block_rows: int) -> DataFrame:
    """Links between nodes of different roots in the groups (grp, id)."""

    def prune(table: pa.Table) -> pa.Table:
        keep = with_partner(trees(table, ("grp", "lo", "hi")), A.column(table, "root").to_numpy(), _spreads(A.column(table, "spread")), similarity)
        return table.select(["grp", "id", "root", "lo", "hi"]).filter(pa.array(keep))

    def link(table: pa.Table) -> pa.Table:
        # nodes that were joined before share a label
        _, first, same = np.unique(A.column(table, "root").to_numpy(), return_index=True, return_inverse=True)
        label = Label(first[same])
        verify(trees(table, ("grp", "lo", "hi")), unpacked(A.column(table, "shingles")), label, similarity)
        return label.edges(A.column(table, "id").to_numpy())

    told = checkpointed(groups.join(roots.withColumnRenamed("node", "id"), "id", "left").select("grp", "id", F.coalesce("root", "id").alias("root")))
    # groups of one component alone have nothing left to join
    apart = told.groupBy("grp").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("grp")
    left = checkpointed(told.join(apart, "grp", "left_semi"))
    count = left.count()
    shard = F.pmod(F.xxhash64("grp", "lo", "hi"), F.lit(max(24, count // SHARD_NODES)).cast("long"))
    slim = shared_out(left, ["grp"], F.xxhash64("id"), block_rows).join(nodes.select("id", "spread"), "id")
    slim = checkpointed(slim.withColumn("shard", shard).groupBy("shard").applyInArrow(prune, "grp long, id long, root long, lo long, hi long"))
    wanted = checkpointed(slim.select("id").distinct())
    sets = nodes.select("id", "shingles").join(small(wanted), "id", "left_semi")
    return checkpointed(slim.join(sets, "id").withColumn("shard", shard).groupBy("shard").applyInArrow(link, "a long, b long"))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots with further links taken in."""
    return roots if links.isEmpty() else checkpointed(components(links.unionAll(roots.select("node", "root"))))


def _components(rows: DataFrame, shingle: int, radius: int, similarity: float, block_rows: int) -> DataFrame:
    """node, first, root of each node; root is the least id of its component."""
    bounded_batches(rows.sparkSession)
    path = table_folder(rows.sparkSession, "near-nodes")
    nodes = _nodes(rows, shingle, path)
    count, size = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("shingles")), F.lit(0))).first()
    roots = checkpointed(components(_tree_links(nodes, max(24, count // SHARD_NODES, size // SHARD_BYTES), radius, similarity, block_rows)))
    keyed = nodes.select("id", F.posexplode("keys").alias("place", "key")).where("place > 0").select(F.xxhash64("place", "key").alias("grp"), "id")
    keyed = checkpointed(keyed)
    met = keyed.groupBy("grp").count().where("count > 1").select("grp")
    roots = _joined(roots, _group_links(nodes, keyed.join(met, "grp", "left_semi"), roots, similarity, block_rows))
    roots = _joined(roots, _group_links(nodes, prefix_groups(nodes, similarity, count), roots, similarity, block_rows))
    # texts without shingles are one group
    empty = nodes.where("size(keys) = 0").select("id")
    bare = empty.join(F.broadcast(empty.agg(F.min("id").alias("b"))), F.col("id") > F.col("b")).select(F.col("id").alias("a"), "b")
    roots = _joined(roots, checkpointed(bare))
    got = checkpointed(nodes.select("node", "first", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("node", "first", F.coalesce("root", "id").alias("root")))
    remove(rows.sparkSession, path)
    return got


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 18, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 4_000) -> DataFrame:
    """doc_id and component_id of each distinct id.

    Two texts link if the Jaccard similarity of their sets of `shingle`-word shingles (A-Z
    lower-cased; of fewer words the whole) is `similarity` or more; no link is lost, whatever
    the fingerprints' distance. Texts without words, null ones included, make one group.
    component_id is the smallest doc_id of the group. A null id is skipped; rows of one id are
    one document with several texts, in the group of the smallest component_id. Other columns
    are ignored, whatever their names. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null").withColumn("node", same_text(F.col("text")))
    rooted = _components(rows, shingle, radius, similarity, block_rows)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = checkpointed(hot_join(rooted, least, "root").select("node", "component_id"))
    pairs = checkpointed(rows.select("doc_id", "node").distinct())
    return hot_join(pairs, named, "node").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 18, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 4_000) -> DataFrame:
    """One row of docs for each group of near-duplicate texts (near_duplicates' links), and all rows with a null id.

    The row with the smallest id stays; where that id has several texts of the group, one of
    them, chosen by a hash; of rows with the same id and text one. All columns are kept,
    whatever their names. Null texts count as empty. An empty table gives no rows.
    """
    id_, words = F.col(id_col).cast("long"), same_text(F.col(text_col).cast("string"))
    rows = docs.select(id_.alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null").withColumn("node", same_text(F.col("text")))
    rooted = _components(rows, shingle, radius, similarity, block_rows)
    keep = checkpointed(rooted.groupBy("root").agg(F.min(F.struct("first", "node")).alias("k")).select(F.col("k.first").alias("_id"), F.col("k.node").alias("_node")))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    one = docs.select(id_.alias("_id"), words.alias("_node"), row).where("_id is not null").join(small(keep), ["_id", "_node"], "left_semi")
    if rows.select("doc_id", "node").groupBy("doc_id", "node").count().where("count > 1").limit(1).count():
        one = one.groupBy("_id", "_node").agg(F.first("_row").alias("_row"))
    return one.select("_row.*").unionByName(docs.where(F.col(id_col).isNull()))
