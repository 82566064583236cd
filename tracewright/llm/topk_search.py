"""Exact top-k inner-product search with a three-phase uniform threshold (operator 8).

A score is the sum of partial scores over `slices` of the dimensions. Vectors lie in blocks of
near ones (by the nearest of a bounded sample of them); a list is one slice of one block, a
row of its own, with the centre and radius of what it holds. Queries come in blocks of bounded
size, broadcast one at a time.

Phase 1: the lists give each query's best partial scores; those few entries are resolved
exactly, and the k-th best of them is a cutoff that the true top k can't fall below. Phase 2:
the cutoffs are broadcast, and a list sends the entries whose partial score reaches
cutoff / slices - an entry that does so in no list can't reach the cutoff. Lists that can't
reach it by centre and radius are not scored at all (in phase 1: those that can't improve
what was found before). Phase 3: the entries collected are resolved exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm import _arrays as A
from tracewright.llm._links import bounded_batches, checkpointed, small

#: Bytes of one block of vectors, and of one broadcast block of queries.
BLOCK_BYTES, QUERY_BYTES = 2 << 20, 16 << 20
#: Vectors that blocks are formed around, at most: the first by a hash of the id.
PIVOTS = 64
#: Queries that a task scores at a time.
STEP = 256
#: What rounding may add to or take from a bound, as a share of it.
SLACK = 1e-9
MESSAGE = "place long, payload binary"


def parts_of(width: int, slices: int) -> list[slice]:
    edge = [round(width * k / slices) for k in range(slices + 1)]
    return [slice(a, b) for a, b in zip(edge, edge[1:], strict=False) if a < b] or [slice(0, 0)]


def _small(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether doubles hold all sums of products exactly."""
    return np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[-1]) < 2.0**53


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly: in doubles where they do, else in Python's integers."""
    if _small(q, x):
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    out = [sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for r, s in zip(q.tolist(), x.tolist(), strict=True)]
    if any(abs(v) >= 2**63 for v in out):
        raise OverflowError("a score doesn't fit a long")
    return np.array(out, np.int64)


@dataclass
class Scores:
    """One list: partial scores on demand, and how many were computed."""

    ids: np.ndarray
    x: np.ndarray
    centre: np.ndarray
    radius: float

    def most(self, q: np.ndarray) -> np.ndarray:
        """No entry's partial score is higher."""
        if not np.isfinite(self.radius) or not _small(q, self.x):
            return np.full(len(q), np.inf)
        far = np.sqrt((q * q).sum(axis=1)) * self.radius
        near = q @ self.centre
        return near + far + SLACK * (np.abs(near) + far + 1)


@dataclass
class Queries:
    """The queries of one width in a block: the first one's number, ids and vectors."""

    first: int
    ids: np.ndarray
    x: np.ndarray
    cutoff: np.ndarray = field(default_factory=lambda: np.zeros(0))


class Tops:
    """Each query's k best partial scores in the lists of one slice that a task has met."""

    def __init__(self, queries: Queries, part: slice, k: int):
        self.queries, self.q, self.k = queries, np.ascontiguousarray(queries.x[:, part]), k
        n = len(queries.ids)
        self.score, self.place, self.at = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64), np.zeros((n, k), np.int64)
        self.scored = 0

    def meet(self, place: int, found: Scores) -> None:
        live = np.flatnonzero((found.most(self.q) >= self.score[:, -1]) | (self.place[:, -1] < 0))
        for a in range(0, len(live), STEP):
            some = live[a : a + STEP]
            partial = self.q[some] @ found.x.T
            self.scored += partial.size
            partial[found.ids[None, :] == self.queries.ids[some, None]] = -np.inf
            partial = np.nan_to_num(partial, nan=np.finfo(float).max, posinf=np.finfo(float).max, neginf=-np.inf)
            few = min(self.k, partial.shape[1])
            best = np.argpartition(-partial, few - 1, axis=1)[:, :few]
            score = np.concatenate([self.score[some], np.take_along_axis(partial, best, 1)], axis=1)
            where = np.concatenate([self.place[some], np.full(best.shape, place)], axis=1)
            at = np.concatenate([self.at[some], best], axis=1)
            where[score == -np.inf] = -1
            order = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
            self.score[some], self.place[some], self.at[some] = (np.take_along_axis(x, order, 1) for x in (score, where, at))

    def entries(self) -> Iterator[tuple[int, bytes]]:
        row, col = np.nonzero(self.place >= 0)
        place, at = self.place[row, col], self.at[row, col]
        order = np.argsort(place, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
            if len(some):
                yield int(place[some[0]]), pack(row[some] + self.queries.first, at[some])


def pack(query: np.ndarray, at: np.ndarray) -> bytes:
    return np.stack([query, at]).astype(np.int32).tobytes()


def reaching(queries: Queries, part: slice, slices: int, found: Scores) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, entry) pairs whose partial score reaches the query's share of its cutoff, and how many were scored."""
    q = np.ascontiguousarray(queries.x[:, part])
    share = queries.cutoff / slices
    share = share - SLACK * (np.abs(share) + 1)
    live = np.flatnonzero(found.most(q) >= share)
    rows, cols, scored = [], [], 0
    for a in range(0, len(live), STEP):
        some = live[a : a + STEP]
        if _small(q[some], found.x):
            partial = q[some] @ found.x.T
            scored += partial.size
            hit = partial >= share[some, None]
        else:
            hit = np.ones((len(some), len(found.ids)), dtype=bool)
        hit &= found.ids[None, :] != queries.ids[some, None]
        i, j = np.nonzero(hit)
        rows.append(some[i] + queries.first)
        cols.append(j)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *cols]), scored


def resolved(payloads: list[bytes], block: dict[int, Queries], ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the query, id and exact score of the k best among the entries of one block of vectors; ties to the smaller id."""
    pair = np.concatenate([np.zeros((2, 0), np.int32), *(np.frombuffer(p, np.int32).reshape(2, -1) for p in payloads)], axis=1).astype(np.int64)
    key = np.unique(pair[0] * len(ids) + pair[1])
    query, at = key // len(ids), key % len(ids)
    mine = block[x.shape[1]]
    step, score = max(1, (4 << 20) // max(1, x.shape[1])), np.zeros(len(key), np.int64)
    for a in range(0, len(key), step):
        score[a : a + step] = _exact(mine.x[query[a : a + step] - mine.first], x[at[a : a + step]])
    order = np.lexsort((ids[at], -score, query))
    query, at, score = query[order], at[order], score[order]
    head = np.searchsorted(query, query)
    keep = np.arange(len(query)) - head < k
    return query[keep], ids[at[keep]], score[keep]


def _matrix(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, np.float64).reshape(-1, width) if width else np.zeros((1, 0))


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, n and data (doubles): floor(256 * x) of each component; vectors that are null or hold null or non-finite components are left out."""

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, data = [], [], []
            for k, v in zip(batch.column(0), batch.column(1), strict=True):
                if not k.is_valid or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    with np.errstate(over="ignore"):
                        x = np.floor(x * 256.0)
                    if not np.isfinite(x).all():
                        raise OverflowError("a component is too large")
                    ids.append(k.as_py())
                    n.append(len(x))
                    data.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["vec_id", "n", "data"])

    kind = vectors.select(F.col(vector_col)).schema[0].dataType.simpleString()
    source = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), source.alias("v")).mapInArrow(act, "vec_id long, n long, data binary")


def _nearest(vectors: DataFrame) -> DataFrame:
    """vectors with `pivot`, the number of the nearest pivot of their width (-1 if there is none)."""
    some = vectors.orderBy(F.xxhash64("vec_id", "data"), "vec_id", "data").limit(PIVOTS).select("n", "data").toArrow()
    pivots: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for k, (n, data) in enumerate(zip(some["n"].to_pylist(), some["data"].to_pylist(), strict=True)):
        names, rows = pivots.setdefault(n, ([], []))
        names.append(k)
        rows.append(np.frombuffer(data, np.float64))
    known = {n: (np.array(names), np.array(rows)) for n, (names, rows) in pivots.items()}

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                names, rows = known.get(n, (None, None))
                with np.errstate(over="ignore", invalid="ignore"):
                    out.append(-1 if names is None else int(names[np.argmin(((rows - np.frombuffer(data, np.float64)) ** 2).sum(axis=1))]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "pivot"])

    return vectors.mapInArrow(act, "vec_id long, n long, data binary, pivot long")


def _blocks(vectors: DataFrame) -> DataFrame:
    """Vectors packed in blocks of up to about BLOCK_BYTES: place, n, ids and data."""
    near = checkpointed(_nearest(vectors))
    room = F.greatest(F.lit(64), F.floor(F.lit(BLOCK_BYTES) / (8 * F.greatest("n", F.lit(1)))))
    sizes = checkpointed(near.groupBy("n", "pivot").count().select("n", "pivot", F.ceil(F.col("count") / room).cast("long").alias("cuts")))
    # equal rows fall into any cut of their pivot
    cut = F.pmod(F.xxhash64("vec_id", "data", F.monotonically_increasing_id()), F.col("cuts"))
    dealt = checkpointed(near.join(small(sizes), ["n", "pivot"]).withColumn("cut", cut).drop("cuts"))

    def act(table: pa.Table) -> pa.Table:
        ids, data = A.column(table, "vec_id").to_numpy(), table["data"].to_pylist()
        order = np.argsort(ids, kind="stable")
        return pa.table([pa.array([table["n"][0].as_py()], pa.int64()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([b"".join(data[i] for i in order.tolist())], pa.binary())], ["n", "ids", "data"])

    packed = dealt.groupBy("n", "pivot", "cut").applyInArrow(act, "n long, ids binary, data binary")
    return checkpointed(checkpointed(packed).withColumn("place", F.monotonically_increasing_id()))


def _lists(blocks: DataFrame, slices: int) -> DataFrame:
    """One row a slice of a block: place, n, slice, ids, data, centre and radius."""
    schema = "place long, n long, slice int, ids binary, data binary, centre binary, radius double"

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                x = _matrix(row["data"], row["n"]) if row["n"] else np.zeros((len(ids), 0))
                for k, part in enumerate(parts_of(row["n"], slices)):
                    mine = np.ascontiguousarray(x[:, part])
                    with np.errstate(over="ignore", invalid="ignore"):
                        centre = mine.mean(axis=0)
                        radius = float(np.sqrt(((mine - centre) ** 2).sum(axis=1)).max()) * (1 + SLACK)
                    out = (row["place"], row["n"], k, row["ids"], mine.tobytes(), centre.tobytes(), radius if np.isfinite(radius) else float("inf"))
                    yield pa.RecordBatch.from_pylist([dict(zip(("place", "n", "slice", "ids", "data", "centre", "radius"), out, strict=True))], pa.schema([("place", pa.int64()), ("n", pa.int64()), ("slice", pa.int32()), ("ids", pa.binary()), ("data", pa.binary()), ("centre", pa.binary()), ("radius", pa.float64())]))

    lists = max(1, blocks.count() * slices)
    return checkpointed(blocks.mapInArrow(act, schema).repartition(max(24, lists // 16), "place", "slice"))


def _scores(row: dict) -> Scores:
    ids = np.frombuffer(row["ids"], np.int64)
    x = np.frombuffer(row["data"], np.float64).reshape(len(ids), -1) if len(row["data"]) else np.zeros((len(ids), 0))
    return Scores(ids, x, np.frombuffer(row["centre"], np.float64), row["radius"])


def _query_block(asked: DataFrame, number: int) -> dict[int, Queries]:
    """The queries of one block, by width."""
    got = asked.where(F.col("block") == number).orderBy("n", "vec_id", "data").toArrow()
    n, ids, data = got["n"].to_numpy(), got["vec_id"].to_numpy(), got["data"].to_pylist()
    out: dict[int, Queries] = {}
    for width in np.unique(n).tolist():
        mine = np.flatnonzero(n == width)
        x = np.frombuffer(b"".join(data[i] for i in mine), np.float64).reshape(len(mine), width)
        out[width] = Queries(int(mine[0]), ids[mine], x, np.full(len(mine), -np.inf))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, slices: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k highest integer inner products.

    Components count as floor(256 * x). Candidates are all vectors of the query's width but
    those with the query's own id; ties go to the smaller id; fewer candidates give fewer
    rows. Null vectors, null ids and vectors with null or non-finite components take no part.
    A finite component beyond what 256 times it can hold, or a score beyond a long, raises
    OverflowError. Repeated rows of one id are candidates each, and queries each where they
    differ; a query's rows of one id share their ranks. Other columns are ignored, whatever
    their names. Empty tables give no rows.
    """
    if k < 1 or slices < 1:
        raise ValueError("k and slices must be at least 1")
    spark = vectors.sparkSession
    bounded_batches(spark)
    vecs = checkpointed(whole_numbers(vectors, id_col, vector_col))
    asked = whole_numbers(queries, id_col, vector_col).dropDuplicates(["vec_id", "data"])
    asked = checkpointed(asked)
    wanted = int(asked.agg(F.sum(F.octet_length("data") + 8)).first()[0] or 0)
    rounds = -(-wanted // QUERY_BYTES)
    asked = checkpointed(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "data"), F.lit(max(1, rounds)).cast("long"))))
    out = None
    if rounds:
        blocks = _blocks(vecs)
        lists = _lists(blocks, slices)
        tasks = max(24, blocks.count())
        for number in range(rounds):
            block = _query_block(asked, number)
            got = _one_block(spark, block, blocks, lists, tasks, k, slices)
            out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _one_block(spark, block: dict[int, Queries], blocks: DataFrame, lists: DataFrame, tasks: int, k: int, slices: int) -> DataFrame:
    """query_id, vec_id and score of all entries that can be among the k best of the queries of a block."""
    shared = spark.sparkContext.broadcast(block)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[tuple[int, int], Tops] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                mine = shared.value.get(row["n"])
                if mine is not None:
                    key = row["n"], row["slice"]
                    if key not in tops:
                        tops[key] = Tops(mine, parts_of(row["n"], slices)[row["slice"]], k)
                    tops[key].meet(row["place"], _scores(row))
        yield from _sent(x for top in tops.values() for x in top.entries())

    def resolve(known):
        def act(mine: pa.Table, told: pa.Table) -> pa.Table:
            number, ids, score = (np.zeros(0, np.int64),) * 3
            names = number
            if mine.num_rows and told.num_rows:
                row = mine.to_pylist()[0]
                all_ids = np.frombuffer(row["ids"], np.int64)
                x = np.frombuffer(row["data"], np.float64).reshape(len(all_ids), -1) if row["n"] else np.zeros((len(all_ids), 0))
                number, ids, score = resolved(told["payload"].to_pylist(), known.value, all_ids, x, k)
                names = known.value[row["n"]].ids[number - known.value[row["n"]].first]
            return pa.table([pa.array(number), pa.array(names), pa.array(ids), pa.array(score)], ["number", "query_id", "vec_id", "score"])

        return act

    def met(messages: DataFrame, known) -> DataFrame:
        right = messages.repartition(tasks, "place").groupBy("place")
        return blocks.repartition(tasks, "place").groupBy("place").cogroup(right).applyInArrow(resolve(known), "number long, query_id long, vec_id long, score long")

    best = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    few = met(lists.mapInArrow(local, MESSAGE), shared)
    # one number a query of the block comes to the driver and goes out again
    kth = few.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("number", "score").toArrow()
    cutoff = dict(zip(kth["number"].to_pylist(), kth["score"].to_pylist(), strict=True))
    for mine in block.values():
        mine.cutoff = np.array([float(cutoff.get(mine.first + i, -np.inf)) for i in range(len(mine.ids))])
    told = spark.sparkContext.broadcast(block)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                mine = told.value.get(row["n"])
                if mine is not None:
                    parts = parts_of(row["n"], slices)
                    query, at, _ = reaching(mine, parts[row["slice"]], len(parts), _scores(row))
                    if len(query):
                        yield from _sent([(row["place"], pack(query, at))])

    found = checkpointed(met(lists.mapInArrow(collect, MESSAGE), told).select("query_id", "vec_id", "score"))
    shared.unpersist()
    told.unpersist()
    return found


def _sent(rows) -> Iterator[pa.RecordBatch]:
    for place, payload in rows:
        yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([payload], pa.binary())], ["place", "payload"])
