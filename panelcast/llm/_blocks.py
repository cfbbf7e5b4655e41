"""Questions from blocks of documents to buckets of keys, and the answers back.

Counting windows or n-grams of a whole corpus needs each key's total at every place that holds the
key. Here documents are dealt into blocks of bounded size by a hash (one shuffle of the texts, which
Spark reuses for every pass). A block sends each bucket of the key space one message with its
distinct keys of that bucket, and none where it has no such keys, so there are never more messages than
keys; the bucket adds up what all blocks sent and answers each with one message in the same order.
A frequent key costs a message one entry, however often it occurs, so no key is hot; a bucket holds
an equal share of the hash space. Nothing reaches the driver.

Rows equal in id and text are dealt by the input partition they come from, so a hot row does not fill
one block; within a block they are collapsed first, and what is learned of one holds for all.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of text in a block: up to a terabyte, and at most. In between the size grows with the
#: square root of the corpus, as blocks times buckets bounds the messages.
BLOCK_CHARS, MOST_CHARS, UP_TO = 8_000_000, 64_000_000, 10**12
#: Small corpora are dealt into a block a core, of this size at least.
SMALL_CHARS = 2_000_000
MOST_PARTITIONS = 100_000


@dataclass(frozen=True)
class Layout:
    """Characters in the corpus, blocks (and buckets), shuffle partitions."""

    chars: int
    n: int
    partitions: int


def block_chars(total: int) -> int:
    return max(BLOCK_CHARS, min(MOST_CHARS, int(BLOCK_CHARS * (total / UP_TO) ** 0.5)))


def layout(df: DataFrame, text_col: str, chars: int | None = None) -> Layout:
    """How ``df`` is dealt; ``chars`` fixes a block's size."""
    total = int(df.select(F.sum(F.length(text_col))).first()[0] or 0)
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-total // chars)) if chars else max(1, -(-total // block_chars(total)), min(cores, -(-total // SMALL_CHARS)))
    return Layout(total, n, min(n, MOST_PARTITIONS))


def blocked(df: DataFrame, plan: Layout, id_col: str, text_col: str, **more: Column) -> DataFrame:
    """(block, id, text, ...) with rows dealt into blocks by a hash of id, text and input partition."""
    block = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.spark_partition_id()), F.lit(plan.n)).alias("block")
    rows = df.select(block, F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[c.alias(k) for k, c in more.items()])
    return rows.repartition(plan.partitions, "block")


def collapsed(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(the rows distinct in id and text, how often each occurs, the distinct row of every row)."""
    table = table.combine_chunks()
    codes = np.zeros(table.num_rows, np.int64)
    for name in ("id", "text"):
        col = table.column(name)
        coded = (col.chunk(0) if col.num_chunks else pa.array([], col.type)).dictionary_encode()
        codes = codes * (len(coded.dictionary) + 1) + np.asarray(coded.indices.fill_null(len(coded.dictionary)), np.int64)
    _, first, of, times = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
    if len(first) == table.num_rows:
        return table, np.ones(len(first), np.int64), np.arange(len(first))
    order = np.argsort(first)  # as they came
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return table.take(pa.array(first[order])), times[order], back[of]


def ask(blocks: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``fn`` makes of each block: rows with ``bucket`` and ``block``."""
    return blocks.groupBy("block").applyInArrow(fn, schema)


def answer(asked: DataFrame, plan: Layout, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``fn`` makes of each bucket's messages: rows with ``block`` and ``bucket``, back at their blocks.

    The shuffles are part of the plan here, so that Spark reuses them where answers are read again.
    """
    return asked.repartition(plan.partitions, "bucket").groupBy("bucket").applyInArrow(fn, schema).repartition(plan.partitions, "block")


def tell(blocks: DataFrame, answers: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``fn`` makes of each block and its answers."""
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(fn, schema)


def varints(values: np.ndarray) -> bytes:
    """Non-negative integers in 7-bit groups, lowest first."""
    v = np.asarray(values, np.uint64)
    if not len(v):
        return b""
    size = np.ones(len(v), np.int64)
    for k in range(1, -(-int(v.max()).bit_length() // 7)):
        size += v >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]), np.uint8)
    start = ends - size
    for k in range(int(size.max())):
        has = size > k
        group = (v[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[start[has] + k] = group.astype(np.uint8) | ((size[has] > k + 1).astype(np.uint8) << 7)
    return out.tobytes()


def integers(raw: bytes) -> np.ndarray:
    """What ``varints`` wrote."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts + 1
    out = np.zeros(len(ends), np.uint64)
    for k in range(int(size.max())):
        has = size > k
        out[has] |= (b[starts[has] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out


_HEAD = struct.Struct("<BII")


def counted_keys(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys with their counts in little more space than their order needs.

    The upper bits of neighbours differ by little: their difference, times four plus the count (up to 3),
    takes a byte or two; the lower bytes follow as they are.
    """
    n = len(keys)
    if not n:
        return _HEAD.pack(0, 0, 0)
    low = max(0, (max(1, (int(keys[-1]) - int(keys[0])) // n).bit_length() - 2) // 8)
    high = keys >> np.uint64(8 * low)
    steps = varints(np.diff(high, prepend=high[:1]) * np.uint64(4) + np.minimum(counts, 3).astype(np.uint64))
    rest = np.ascontiguousarray(keys, "<u8").view(np.uint8).reshape(n, 8)
    return _HEAD.pack(low, n, len(steps)) + keys[:1].astype("<u8").tobytes() + steps + rest[:, :low].tobytes() + varints(counts[counts >= 3] - 3)


def keys_counted(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What ``counted_keys`` wrote."""
    low, n, size = _HEAD.unpack_from(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = _HEAD.size + 8
    first = np.frombuffer(raw, "<u8", 1, _HEAD.size)[0]
    steps = integers(raw[at : at + size])
    counts = (steps & np.uint64(3)).astype(np.int64)
    high = (first >> np.uint64(8 * low)) + np.cumsum(steps >> np.uint64(2), dtype=np.uint64)
    rest = np.zeros((n, 8), np.uint8)
    rest[:, :low] = np.frombuffer(raw, np.uint8, n * low, at + size).reshape(n, low)
    more = counts == 3
    counts[more] += integers(raw[at + size + n * low :]).astype(np.int64)
    return (high << np.uint64(8 * low)) | rest.view("<u8")[:, 0], counts


def differences(sorted_values: np.ndarray) -> bytes:
    """Sorted non-negative integers as varints of their differences."""
    v = np.asarray(sorted_values, np.uint64)
    return varints(np.diff(v, prepend=np.uint64(0)))


def sums(raw: bytes) -> np.ndarray:
    """What ``differences`` wrote."""
    return np.cumsum(integers(raw), dtype=np.uint64)


def bucket_of(keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of each key of ``bits`` bits: n equal ranges in order of the keys."""
    top = keys >> np.uint64(max(0, bits - 32)) if bits > 32 else keys << np.uint64(32 - bits)
    return (top * np.uint64(n)) >> np.uint64(32)


def cuts(sorted_keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Where each of the n buckets starts among sorted keys, and the end."""
    return np.searchsorted(bucket_of(sorted_keys, n, bits), np.arange(n + 1, dtype=np.uint64))


def cells(table: pa.Table, name: str) -> list[bytes]:
    return table.column(name).to_pylist()
