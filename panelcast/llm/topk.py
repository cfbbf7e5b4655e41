"""Operator 3: exact top-k search by distributed histogram selection.

Vectors are packed once into blocks of ``ROWS`` candidates and of about ``BLOCK`` queries, tables in the
shared folder. A pass meets every block of queries with every block of candidates in one job, scores
both with a matrix product and counts all scores into ``BINS`` bins a query between that query's
bounds. Counts are added up over the cluster; the bin that holds the k-th highest score gives the
query's next bounds, until it is one integer wide: the k-th value. A block tells of its bins from
the top down to the one that holds its own k-th score, as no lower one can hold the k-th of all. A last
pass keeps scores at or above that value; of those equal to it a block keeps the k smallest ids,
which loses nothing, and the final ranks go by score and then id. Bounds stay in tables; of a pass,
the driver learns one number. Blocks of queries are sent to ``SLOTS``-th parts of the candidates, so a
task holds one pair of blocks at a time whatever the tables measure.

Scores are integers: components are quantised to floor(scale * x). Vectors null or with null or
non-finite components take no part, as query or candidate; neither do null ids. Rows are told apart
by a number of their own: of rows with equal ids each is a candidate, also of the others, and each query
row is answered. Vectors of a length other than the query's never match it. Fewer than k
candidates give fewer rows; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm import _base as B

BLOCK, ROWS = 1024, 4096
BINS = 1024
#: Candidate blocks that share one copy of the queries.
SLOTS = 8
_OWN = -(1 << 62)


def quantised(df: DataFrame, is_query: Column, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, asks, dim, v array<double>) of the rows that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * scale).cast("double"))
    return df.filter(fine).select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.size(vec_col).alias("dim"), whole.alias("v"))


def packed(matrix: np.ndarray) -> tuple[str, bytes]:
    """Integers in the narrowest type that holds them: (type, bytes)."""
    most = np.abs(matrix).max(initial=0)
    kind = next((k for k in ("int8", "int16", "int32") if most <= np.iinfo(k).max), "float64")
    return kind, matrix.astype(kind).tobytes()


def unpacked(kind: str, raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(n, -1).astype(float)


_BLOCK = "dim int, block bigint, n int, asking int, norm double, kind string, body binary, ids binary, rows binary, asks binary"


def _batch(rows: list[tuple], order: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    names = [f.split() for f in order.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(names)], [n for n, _ in names])


def _norm(matrix: np.ndarray) -> float:
    return float(np.sqrt((matrix**2).sum(1).max(initial=0)))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, asks, dim, v) as blocks of one length, rows numbered across the table."""
    first, rows = TaskContext.get().partitionId() << 36, 0
    held: dict[int, list] = {}

    def flush(dim: int) -> tuple:
        ids, numbers, asks, parts = (np.concatenate(x) for x in zip(*held.pop(dim)))
        kind, body = packed(parts)
        return (dim, int(numbers[0]), len(ids), int(asks.sum()), _norm(parts), kind, body, ids.tobytes(), numbers.tobytes(), asks.tobytes())

    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        for dim in np.unique(dims).tolist():
            mine = batch.filter(pa.array(dims == dim))
            for at in range(0, mine.num_rows, ROWS):
                part = mine.slice(at, ROWS)
                n = part.num_rows
                matrix = np.asarray(part.column("v").flatten(), float).reshape(n, dim)
                asks = np.asarray(part.column("asks").to_numpy(zero_copy_only=False), bool)
                held.setdefault(dim, []).append((np.asarray(part.column("id")), first + rows + np.arange(n), asks, matrix))
                rows += n
                if sum(len(x[0]) for x in held[dim]) >= ROWS:
                    yield _batch([flush(dim)], _BLOCK)
        if len(held) > 256:  # many lengths: what is held stays bounded
            for dim in list(held):
                yield _batch([flush(dim)], _BLOCK)
    for dim in list(held):
        yield _batch([flush(dim)], _BLOCK)


_ASKED = "dim int, qb bigint, n int, kind string, body binary, ids binary, rows binary, low binary, width binary, widest bigint"


def _asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The query rows of candidate blocks."""
    order = "dim int, id bigint, row bigint, kind string, body binary"
    for batch in batches:
        for r in batch.to_pylist():
            if r["asking"]:
                ids, rows, asks = (np.frombuffer(r[c], t) for c, t in (("ids", np.int64), ("rows", np.int64), ("asks", bool)))
                matrix = np.frombuffer(r["body"], r["kind"]).reshape(r["n"], -1)
                yield _batch([(r["dim"], int(ids[i]), int(rows[i]), r["kind"], matrix[i].tobytes()) for i in np.flatnonzero(asks).tolist()], order)


def _query_block(most: float, table: pa.Table) -> pa.Table:
    """A block of queries with their first bounds: no score lies beyond norm times norm."""
    table = table.sort_by("row")
    dim, qb = table.column("dim")[0].as_py(), table.column("qb")[0].as_py()
    matrix = np.stack([np.frombuffer(b, k).astype(float) for b, k in zip(table.column("body").to_pylist(), table.column("kind").to_pylist())]).reshape(table.num_rows, dim)
    reach = (np.sqrt((matrix**2).sum(1)) * most * (1 + 1e-9)).astype(np.int64) + 1
    width = -(-(2 * reach + 1) // BINS)
    kind, body = packed(matrix)
    ids, rows = (np.asarray(table.column(c).combine_chunks(), np.int64).tobytes() for c in ("id", "row"))
    return pa.Table.from_batches([_batch([(dim, qb, table.num_rows, kind, body, ids, rows, (-reach).tobytes(), width.tobytes(), int(width.max()))], _ASKED)])


def _scores(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores[candidate, query], low, width) of a pair of blocks; the query's own row gets _OWN."""
    c, q = unpacked(r["c_kind"], r["c_body"], r["c_n"]), unpacked(r["kind"], r["body"], r["n"])
    if np.abs(q).sum(1).max(initial=0) * np.abs(c).max(initial=0) < 2**53:
        s = c @ q.T  # sums of integers that doubles hold
    else:
        s = c.astype(np.int64) @ q.astype(np.int64).T
    own, rows = np.frombuffer(r["c_rows"], np.int64), np.frombuffer(r["rows"], np.int64)
    at = np.minimum(np.searchsorted(own, rows), len(own) - 1)  # rows are numbered in order
    same = np.flatnonzero(own[at] == rows)
    s[at[same], same] = _OWN
    return s, np.frombuffer(r["low"], np.int64), np.frombuffer(r["width"], np.int64)


def _count(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, qb, q, b, n): how many scores of each pair of blocks lie in bin b of query q."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            s, low, width = _scores(r)
            bins = np.minimum((s - low) // width, BINS).astype(np.int64)  # the last bin takes all scores above
            bins += np.arange(r["n"]) * (BINS + 1)
            counts = np.bincount(bins[s >= low], minlength=r["n"] * (BINS + 1)).reshape(r["n"], BINS + 1)
            above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts  # in higher bins
            q, b = np.nonzero((counts > 0) & (above < k))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), r["dim"], np.int32)), pa.array(np.full(len(q), r["qb"])), pa.array(q), pa.array(b), pa.array(counts[q, b])], ["dim", "qb", "q", "b", "n"])


def _refine(k: int, asked: pa.Table, counted: pa.Table) -> pa.Table:
    """A block of queries with the bounds of the bins that hold their k-th scores."""
    if not asked.num_rows:
        return pa.Table.from_batches([_batch([], _ASKED)])
    n = asked.column("n")[0].as_py()
    low, width = (np.frombuffer(asked.column(c)[0].as_py(), np.int64).copy() for c in ("low", "width"))
    counts = np.zeros((n, BINS + 1), np.int64)
    counts[np.asarray(counted.column("q")), np.asarray(counted.column("b"))] = np.asarray(counted.column("n"))
    tails = np.cumsum(counts[:, ::-1], axis=1)
    few = tails[:, -1] < k  # too few candidates: all of them are kept
    low = np.where(few, low, low + (BINS - np.argmax(tails >= k, axis=1)) * width)
    width = np.where(few | (width == 1), 1, -(-width // BINS))
    for name, value, kind in (("low", low.tobytes(), pa.binary()), ("width", width.tobytes(), pa.binary()), ("widest", int(width.max()), pa.int64())):
        asked = asked.set_column(asked.column_names.index(name), name, pa.array([value], kind))
    return asked


def _keep(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, query_id, vec_id, score) of the scores at or above the k-th value."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            s, low, _ = _scores(r)
            ids, names, rows = (np.frombuffer(r[c], np.int64) for c in ("c_ids", "ids", "rows"))
            c, q = np.nonzero(s >= low)
            score = s[c, q].astype(np.int64)
            order = np.lexsort((ids[c], -score, q))
            q, c, score = q[order], c[order], score[order]
            starts = np.flatnonzero(np.diff(q, prepend=-1))
            rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
            q, c, score = q[rank < k], c[rank < k], score[rank < k]
            yield pa.RecordBatch.from_arrays([pa.array(rows[q]), pa.array(names[q]), pa.array(ids[c]), pa.array(score)], ["row", "query_id", "vec_id", "score"])


def search(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query row."""
    spark = df.sparkSession
    blocks = B.checkpointed(quantised(df, is_query, id_col, vec_col, scale).mapInArrow(_pack, _BLOCK))
    n_blocks, asking, most = blocks.agg(F.count("*"), F.sum("asking"), F.max("norm")).first()
    if not asking:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    slots = max(1, -(-n_blocks // SLOTS))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), slots)
    names = [F.col(c).alias(f"c_{c}") for c in ("n", "kind", "body", "ids", "rows")]
    candidates = blocks.select("dim", F.pmod(F.xxhash64("block"), F.lit(slots)).alias("slot"), *names)
    single = blocks.mapInArrow(_asking, "dim int, id bigint, row bigint, kind string, body binary")
    dealt = single.withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(-(-asking // BLOCK))))
    asked = B.checkpointed(dealt.groupBy("dim", "qb").applyInArrow(lambda t: _query_block(most, t), _ASKED))

    def pairs() -> DataFrame:
        """Every block of queries beside every block of candidates of its length."""
        copies = asked.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint"))))
        return copies.repartition(parts, "dim", "slot").join(candidates.repartition(parts, "dim", "slot"), ["dim", "slot"])

    while True:
        found = pairs().mapInArrow(lambda b: _count(k, b), "dim int, qb bigint, q bigint, b bigint, n bigint").groupBy("dim", "qb", "q", "b").agg(F.sum("n").alias("n"))
        last = asked.agg(F.max("widest")).first()[0] == 1
        asked = B.checkpointed(asked.groupBy("dim", "qb").cogroup(found.groupBy("dim", "qb")).applyInArrow(lambda a, c: _refine(k, a, c), _ASKED))
        if last:
            break
    near = pairs().mapInArrow(lambda b: _keep(k, b), "row bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
