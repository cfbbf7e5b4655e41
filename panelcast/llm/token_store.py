"""Operator 10: token ids on disk, with Elias-Fano document boundaries.

``write`` tokenises every text, sorts documents by id across the cluster (range partitioning, no
single task), and writes blocks: one concatenated array of token ids and the documents' boundaries
as an Elias-Fano sequence. Blocks are binary values in Parquet, so any file system Spark can write
to holds them and a lost task's files are never seen half-written. ``read_documents`` opens the
blocks again.

Block layout, little-endian: magic ``TOKB``, u8 bytes an id, u8 low bits, u16 zero, u64 documents,
u64 ids; the ids; then, of the boundaries, the packed low bits, the high bits in unary (one set bit
a boundary, zeros stepping the bucket) and, as select structure, the bit position of every 64th set
bit as u32. A boundary costs about 2 + log2(ids / documents) bits instead of 64.

Defined results: null text is the empty text and becomes the end id alone; null ids sort first;
rows of equal id sort by a hash of the text (equal rows are interchangeable); an empty table gives
empty results. Texts are tokenised whole, block sizes bound memory, and a document longer than a
block gets a block of its own.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import _base as B
from panelcast.llm import _text as T

HEAD = struct.Struct("<4sBBHQQ")
SAMPLE = 64
#: Ids in a block; chunks a worker remembers.
BLOCK_IDS, MEMO = 1 << 20, 2_000_000
#: Characters of a range partition at most, on average.
PART_CHARS = 128_000_000
_MARKS = tuple(",.;:!?")


class EliasFano:
    """Non-decreasing integers in near-minimal space, with select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples
        self._bytes = low.tobytes(), high.tobytes()

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        v = values.astype(np.uint64)
        bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QQ", len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: memoryview, n: int, low_bits: int) -> EliasFano:
        lows, highs = struct.unpack_from("<QQ", raw)
        a = 16
        return cls(
            n,
            low_bits,
            np.frombuffer(raw, np.uint8, lows, a),
            np.frombuffer(raw, np.uint8, highs, a + lows),
            np.frombuffer(raw, "<u4", -(-n // SAMPLE), a + lows + highs),
        )

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for j in range(self.low_bits):
            bit = i * self.low_bits + j
            out |= ((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.int64) << j
        return out

    def select(self, i: int) -> int:
        """Value i: the sampled bit position, then a scan of at most SAMPLE set bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        low, high = self._bytes
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        word = int.from_bytes(high[byte : byte + 8], "little") >> (at & 7) << (at & 7)
        while (c := word.bit_count()) <= left:
            left -= c
            byte += 8
            word = int.from_bytes(high[byte : byte + 8], "little")
        for _ in range(left):
            word &= word - 1
        pos = byte * 8 + (word & -word).bit_length() - 1
        bit = i * self.low_bits
        value = int.from_bytes(low[bit >> 3 : (bit + self.low_bits + 7) >> 3], "little") >> (bit & 7)
        return ((pos - i) << self.low_bits) | (value & ((1 << self.low_bits) - 1))

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return ((ones - i) << self.low_bits) | self._low(i)


def pack_block(docs: list[bytes], width: int) -> bytes:
    """A block of documents, each given as its ids' bytes, ``width`` to an id."""
    ends = np.cumsum([0, *(len(d) // width for d in docs)])
    ef = EliasFano.of(ends)
    return HEAD.pack(b"TOKB", width, ef.low_bits, 0, len(docs), int(ends[-1])) + b"".join(docs) + ef.to_bytes()


def open_block(raw: bytes) -> tuple[np.ndarray, EliasFano]:
    """(ids, boundaries): document i has the ids boundaries.select(i) up to boundaries.select(i + 1)."""
    magic, width, low_bits, _, docs, ids = HEAD.unpack_from(raw)
    if magic != b"TOKB":
        raise ValueError("not a token block")
    view = memoryview(raw)
    flat = np.frombuffer(view, f"<u{width}", ids, HEAD.size)
    return flat, EliasFano.from_bytes(view[HEAD.size + ids * width :], docs + 1, low_bits)


class Chunked:
    """A tokenizer that meets each distinct chunk of text once.

    Byte-level pre-tokens never reach over a space between two other characters, so a text's ids
    are those of its chunks; what repeats is looked up.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.width = 2 if self.tool.get_vocab_size() <= 1 << 16 else 4
        self.coder = T.ChunkCoder(T.joint_spans, self.encode_chunks, MEMO)
        self.marks = {m: self.tool.encode(m, add_special_tokens=False).ids for m in _MARKS}

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        # letters and one mark after them are pre-tokens of their own: the letters are encoded once
        cut = [c[:-1] if c[-1:] in _MARKS and c[c[0] == " " : -1].isalpha() else c for c in chunks]
        whole = list(dict.fromkeys(cut))
        coded = {}
        for a in range(0, len(whole), 20_000):
            part = whole[a : a + 20_000]
            coded.update((c, e.ids) for c, e in zip(part, self.tool.encode_batch_fast(part, add_special_tokens=False)))
        return [coded[x] if len(x) == len(c) else coded[x] + self.marks[c[-1]] for x, c in zip(cut, chunks)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for _, ids, bounds in self.coder.encode(pa.array(texts, pa.string())):
            out += [ids[a:b].tolist() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return out


@functools.cache
def tokenizer(path: str) -> Chunked:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Chunked(path)


def write(df: DataFrame, path: str, target: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token file of ``df`` under ``target``; ``path`` is a tokenizer file on each host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        end = np.array([end_id], f"<u{tok.width}").tobytes()
        part = TaskContext.get().partitionId()
        before = block = held = 0
        docs, ids = [], []

        def flush():
            nonlocal before, block, held, docs, ids
            n = held
            row = [[part], [block], [n], [before], [ids], [pack_block(docs, tok.width)]]
            before, block, held, docs, ids = before + n, block + 1, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            names, done = batch.column("id").to_pylist(), 0
            for n, flat, bounds in tok.coder.encode(B.text_array(batch, "text")):
                raw = memoryview(flat.astype(f"<u{tok.width}")).cast("B")
                for i, a, b in zip(names[done : done + n], bounds[:-1].tolist(), bounds[1:].tolist()):
                    if held and held + b - a >= BLOCK_IDS:
                        yield flush()
                    docs.append(bytes(raw[a * tok.width : b * tok.width]) + end)
                    ids.append(i)
                    held += b - a + 1
                done += n
        if docs:
            yield flush()

    kind = df.schema[id_col].dataType
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    arrow_id = pa.string() if kind.simpleString() == "string" else pa.int64()
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n_ids", pa.int64()), ("before", pa.int64()), ("ids", pa.list_(arrow_id)), ("payload", pa.binary())])
    if kind.simpleString() not in ("string", "bigint"):
        narrow = narrow.withColumn("id", F.col("id").cast("bigint"))
    chars = df.select(F.sum(F.length(text_col))).first()[0] or 0
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    ranged = narrow.repartitionByRange(n, *order).sortWithinPartitions(*order)
    name = "string" if arrow_id == pa.string() else "bigint"
    blocks = ranged.mapInArrow(run, f"part int, block bigint, n_ids bigint, before bigint, ids array<{name}>, payload binary")
    blocks.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(target)


def document(bounds: EliasFano, i: int) -> tuple[int, int]:
    """Where document i of a block starts and ends."""
    return bounds.select(i), bounds.select(i + 1)


def block_documents(payload: bytes) -> tuple[np.ndarray, list[int]]:
    """(start and end, CRC-32) of each document of a block, each fetched by select."""
    flat, bounds = open_block(payload)
    wide = memoryview(flat.astype("<u4")).cast("B")
    at = [document(bounds, i) for i in range(bounds.n - 1)]
    return np.array(at, np.int64).reshape(-1, 2), [zlib.crc32(wide[4 * a : 4 * b]) for a, b in at]


def read_documents(spark, target: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document of a token file, from its blocks."""
    blocks = spark.read.parquet(target)
    # one number a partition of the writer
    sums = sorted((r[0], r[1]) for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect())
    starts, total = {}, 0
    for part, n in sums:
        starts[part] = total
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, crc = block_documents(batch.column("payload")[k].as_py())
                start = at[:, 0] + starts[batch.column("part")[k].as_py()] + batch.column("before")[k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[k].values, pa.array(start), pa.array(at[:, 1] - at[:, 0]), pa.array(crc, pa.int64())],
                    ["id", "start", "n_tokens", "ids_crc32"],
                )

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    return blocks.select("part", "before", "ids", "payload").mapInArrow(run, f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def roundtrip(df: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a token file to the shared folder and report each document as read back."""
    spark = df.sparkSession
    target = f"{B.scratch_dir(spark, 'tokens')}/blocks"
    write(df, path, target, end_id, id_col, text_col)
    return read_documents(spark, target).withColumnRenamed("id", id_col)
