"""Rounds of questions between parts of the documents and buckets of keys.

Documents are dealt to parts by a hash of their id. In a round each part sends the distinct
keys of its texts, sorted and packed, one row a (part, bucket); each bucket, a range of key
space, answers with one bit a key: whether another part has it too. So a key that a third of
all rows hold makes at most one entry a part, and nothing but the packed keys is shuffled.
The texts themselves are shuffled once; Spark reuses that exchange in each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm._arrays import U64

MESSAGE = "part long, level int, bucket long, payload binary"
MESSAGE_ARROW = pa.schema([("part", pa.int64()), ("level", pa.int32()), ("bucket", pa.int64()), ("payload", pa.binary())])

#: Bytes of text in one part: LEAST_BYTES up to GROWS_FROM bytes in all, from there with the square root of
#: the input, so that messages between parts and buckets stay large enough; what a Python worker holds follows it.
LEAST_BYTES, MOST_BYTES, GROWS_FROM = 4 << 20, 64 << 20, 1 << 30
LEAST_PARTS = 24
#: Shuffle partitions at most; beyond it, one holds several parts.
MOST_TASKS = 50_000


def text_bytes(docs: DataFrame, text: str) -> int:
    return int(docs.agg(F.sum(F.octet_length(F.col(text)) + F.lit(64).cast("long"))).first()[0] or 0)


def part_count(total: int) -> int:
    """How many parts the texts make, by their whole size."""
    size = min(MOST_BYTES, max(LEAST_BYTES, int(LEAST_BYTES * (total / GROWS_FROM) ** 0.5)))
    return max(LEAST_PARTS, -(-total // size))


def tasks(parts: int) -> int:
    """Shuffle partitions for so many parts; one holds a few of them."""
    return min(MOST_TASKS, max(12, parts // 3))


def deal(docs: DataFrame, parts: int) -> DataFrame:
    """Rows with a part each. Neither rows of one id nor equal rows share a part but by chance, as the input's partition counts too."""
    row = F.xxhash64("doc_id", "text", F.spark_partition_id())
    return docs.withColumn("part", F.pmod(row, F.lit(parts).cast("long"))).repartition(tasks(parts), "part")


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key; sorted keys have sorted buckets."""
    return ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def spans_of(bucket: np.ndarray) -> Iterable[tuple[int, int, int]]:
    """(bucket, from, to) of each run of equal buckets."""
    if not len(bucket):
        return
    cut = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip(np.r_[0, cut], np.r_[cut, len(bucket)], strict=True):
        yield int(bucket[a]), int(a), int(b)


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    part, level, bucket, payload = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table([pa.array(part, pa.int64()), pa.array(level, pa.int32()), pa.array(bucket, pa.int64()), pa.array(payload, pa.binary())], schema=MESSAGE_ARROW)


def replies(table: pa.Table) -> dict[tuple[int, int], bytes]:
    """The payload of each (level, bucket)."""
    return {(a, b): c for a, b, c in zip(table["level"].to_pylist(), table["bucket"].to_pylist(), table["payload"].to_pylist(), strict=True)}


def bits(got: dict[tuple[int, int], bytes], level: int, bucket: np.ndarray, planes: int = 1) -> list[np.ndarray]:
    """The answers, in the order of the sorted keys that were sent; each plane is one bit a key."""
    out = [np.zeros(len(bucket), dtype=bool) for _ in range(planes)]
    for b, i, j in spans_of(bucket):
        raw = np.frombuffer(got[level, b], dtype=np.uint8).reshape(planes, -1)
        for k in range(planes):
            out[k][i:j] = np.unpackbits(raw[k], count=j - i).astype(bool)
    return out


def ask(sent: DataFrame, buckets: int, answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Each bucket's answers to the parts; a shuffle partition for each bucket, as long as there are not too many."""
    return sent.repartition(min(MOST_TASKS, max(12, buckets)), "bucket").groupBy("bucket").applyInArrow(answer, MESSAGE)


def hear(texts: DataFrame, heard: list[DataFrame], parts: int, act: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Each part's texts beside all the answers to it."""
    both = heard[0]
    for more in heard[1:]:
        both = both.unionByName(more)
    return texts.groupBy("part").cogroup(both.repartition(tasks(parts), "part").groupBy("part")).applyInArrow(act, schema)
