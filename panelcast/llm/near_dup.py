"""Operator 8: n-gram Jaccard join with Bayesian candidate pruning.

A document's set holds the hashes of its ``WORDS``-word shingles (a text of fewer words, but not
none, is one shingle); words are ``[^\\x20\\x09-\\x0D]+``. Two documents are linked if their sets'
Jaccard similarity reaches ``threshold``. Steps:

1. Documents with equal sets form a class; only classes are compared from here on.
2. ``BANDS`` bands of ``ROWS`` MinHash values each deal classes into buckets; a pair at similarity 0.8
   misses all buckets with a chance of about 5e-8. Buckets are joined into groups that hold all pairs
   of candidates: one of up to ``SIDE`` classes by its pairs that the pruning below leaves, a larger
   one whole, as a star around its first class, without comparing anything.
3. In a group, pairs are compared by their MinHash values, ``STEP`` at a time. After each step the
   posterior probability that the similarity reaches the threshold, given the matches so far and
   a uniform prior, must not lie below ``TOLERANCE``; a pair that falls below is dropped for good.
4. Only the pairs left are verified exactly, by intersecting shingle sets, where they are found: no
   pairs are sent anywhere. Links are counted, and a spanning forest of them gives the classes of
   linked documents.

A group of many classes (or characters) is split into blocks, every pair of blocks a task's work of
its own, so no group is unbounded and no pair is lost. A text is sent once for each block of its group.
Components' rounds and class tables go through the shared folder; no links, components or
fingerprints reach the driver.

Defined results: null text or a text without words has no set, hence no links and a class of its
own; rows equal in id and text are linked copies; null ids take part; an empty table gives an empty
table; a very long text is hashed in pieces, its set is held whole. ``class_id`` is the smallest id
of the class's documents (null if all are null). Sets of equal 64-bit fingerprint count as equal, and
shingles of equal 64-bit hash as one: for n different ones the chance of an error is n**2 / 2**65.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm import _base as B
from panelcast.llm import _text as T
from panelcast.llm.components import connected_components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP = 32, 4, 16
TOLERANCE = 1e-9
#: Largest bucket that is compared before it joins a group.
SIDE = 512
#: A block's classes and characters at most (on average, as hashing deals them); from LEAST classes a
#: block on, a group is split into up to SPREAD blocks, so that several tasks share it.
BLOCK, BLOCK_CHARS, LEAST, SPREAD = 1024, 2_000_000, 160, 12
#: Hashes of 8 bytes that are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: Rows of a shuffle partition where their number is known.
PART_ROWS = 100_000
_FLAT = 1 << 16
_CELLS = 1 << 22


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, bounds)."""
    hashes, bounds = T.word_hashes(texts, T.SPACE)
    grams, places = T.window_hashes(hashes, bounds, words, 5)
    at = np.searchsorted(places, bounds)
    sizes = np.diff(bounds)
    sets = []
    for i, n in enumerate(sizes.tolist()):
        if n >= words:
            sets.append(np.unique(grams[at[i] : at[i + 1]]))
        else:  # all its words are one shingle
            sets.append(_short(hashes[bounds[i] : bounds[i + 1]]) if n else np.zeros(0, np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _short(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return T.mix(np.array([(words * (T.salted(6, len(words)) | np.uint64(1))).sum() ^ np.uint64(len(words))], np.uint64))


def min_hashes(flat: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """values[text, hash]: the minimum over each set of n hash functions; sets must not be empty."""
    seeds, factors = T.salted(21, n), T.salted(22, n) | np.uint64(1)
    out = np.empty((len(bounds) - 1, n), np.uint64)
    a = 0
    while a < len(bounds) - 1:  # runs of sets that fit the caches
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + _FLAT, "right")) - 1)
        part, starts = flat[bounds[a] : bounds[b]], bounds[a:b] - bounds[a]
        work = np.empty_like(part)
        with np.errstate(over="ignore"):
            for h in range(n):
                np.bitwise_xor(part, seeds[h], out=work)
                np.multiply(work, factors[h], out=work)
                out[a:b, h] = np.minimum.reduceat(work, starts)
        a = b
    return T.mix(out)


_SIGNED = "key bigint, text_hash bigint, chars bigint, sig binary, bands array<bigint>"


def signatures(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, key, text_hash, chars, sig, bands) of every row; key is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                flat, bounds = shingle_sets(B.text_array(part, "text"), words)
                full = np.flatnonzero(np.diff(bounds))
                starts = bounds[:-1][full]
                keys, sigs, bands = [None] * part.num_rows, [None] * part.num_rows, [None] * part.num_rows
                if len(full):
                    with np.errstate(over="ignore"):
                        key = T.mix(np.add.reduceat(T.mix(flat ^ np.uint64(0x5E7)), starts) + np.diff(bounds)[full].astype(np.uint64))
                    mins = min_hashes(flat, np.append(starts, bounds[-1]), BANDS * ROWS)
                    low = mins.astype(np.uint8)
                    mult = T.salted(23, ROWS) | np.uint64(1)
                    with np.errstate(over="ignore"):
                        band = T.mix((mins.reshape(-1, BANDS, ROWS) * mult).sum(2) + T.salted(24, BANDS)).view(np.int64)
                    for i, k, s, b in zip(full.tolist(), key.view(np.int64).tolist(), low, band.tolist()):
                        keys[i], sigs[i], bands[i] = k, s.tobytes(), b
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(keys, pa.int64()), part.column("h"), part.column("c"), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["id", "key", "text_hash", "chars", "sig", "bands"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.length(text_col).cast("long").alias("c"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, {_SIGNED}")


@functools.cache
def least_matches(threshold: float, tolerance: float, n: int) -> tuple[int, ...]:
    """For each step, the fewest matching values whose posterior is not below the tolerance.

    Values are compared by 8 bits, so a pair of similarity s matches with s + (1 - s) / 256.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    out = []
    for seen in range(STEP, n + 1, STEP):
        for m in range(seen + 1):
            log = m * np.log(p) + (seen - m) * np.log1p(-p)
            like = np.exp(log - log.max())
            if like[s >= threshold].sum() / like.sum() >= tolerance:
                out.append(m)
                break
    return tuple(out)


def survivors(sigs: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows of ``sigs`` stay after all steps."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int16)
    for step, least in enumerate(least_matches(threshold, TOLERANCE, sigs.shape[1])):
        part = slice(step * STEP, (step + 1) * STEP)
        matches = matches + (sigs[i[alive], part] == sigs[j[alive], part]).sum(1, dtype=np.int16)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows is connected to by the pairs."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs of rows equal in ``columns``: (rows, where each run starts, and the end)."""
    held: list[pa.RecordBatch] = []

    def give(batches: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(batches).combine_chunks()
        return table, np.concatenate([[0], _changes(table, columns), [table.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        own = _changes(batch, columns)
        new = bool(held) and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in columns)
        if new:
            yield give(held)
            held = []
        last = int(own[-1]) if len(own) else 0
        if last:
            yield give([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield give(held)


def _changes(rows: pa.RecordBatch | pa.Table, columns: list[str]) -> np.ndarray:
    changed = np.zeros(max(0, rows.num_rows - 1), bool)
    for c in columns:
        v = rows.column(c)
        v = np.asarray(v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v)
        changed |= v[1:] != v[:-1]
    return np.flatnonzero(changed) + 1


def pairs_within(starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i < j) of rows within each run, in bounded pieces."""
    sizes = np.diff(starts)
    for n in np.unique(sizes).tolist():
        firsts = starts[:-1][sizes == n]
        if n < 2:
            continue
        if n <= 256:
            a, b = np.triu_indices(n, 1)
            per = max(1, _CELLS // (8 * len(a)))
            for x in range(0, len(firsts), per):
                f = firsts[x : x + per, None]
                yield (f + a).ravel(), (f + b).ravel()
        else:
            for f in firsts.tolist():
                for x in range(n - 1):
                    j = np.arange(f + x + 1, f + n)
                    yield np.full(len(j), f + x), j


def blocks_of(classes: Column, chars: Column) -> Column:
    """How many blocks a group is split into."""
    spread = F.least(F.lit(SPREAD), F.ceil(classes / LEAST))
    return F.greatest(F.ceil(classes / BLOCK), F.ceil(chars / BLOCK_CHARS), spread, F.lit(1)).cast("int")


def block_pairs(members: DataFrame, by: str) -> DataFrame:
    """Rows of groups ``by``, each split into ``blocks`` blocks (equal over a group) and their pairs.

    Adds ``own`` (a row's block), ``lo`` and ``hi``; a group of one block has lo = hi = 0. ``pair`` numbers the
    pairs of a group.
    """
    rows = members.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "blocks")
    return rows.withColumn("pair", (F.col("hi").cast("long") * (F.col("hi") + 1) / 2 + F.col("lo")).cast("long"))


def partitions(df: DataFrame, rows: int) -> int:
    """Partitions for a shuffle of ``rows`` rows: the session's number, more where that is too few."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def candidate_groups(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): edges whose connected components hold every pair of candidates (see the module's text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, ["band"]):
            keys = np.asarray(table.column("key").combine_chunks())
            sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(keys), -1)
            a, b = [], []
            for i, j in pairs_within(starts):
                left = survivors(sigs, i, j, threshold)
                a.append(i[left])
                b.append(j[left])
            if a:
                label = forest(len(keys), np.concatenate(a), np.concatenate(b))
                more = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[more]), pa.array(keys[label[more]])], ["a", "b"])

    rows = classes.select("key", F.explode("bands").alias("band"))
    # written first: then Spark can split the other side of a join on a hot bucket
    sizes = B.checkpointed(rows.groupBy("band").agg(F.count("*").alias("size"), F.min("key").alias("first")).filter(F.col("size") > 1))
    told = sizes.agg(F.sum(F.when(F.col("size") <= SIDE, F.col("size")))).first()[0] or 0
    small = rows.join(sizes.filter(F.col("size") <= SIDE).select("band"), "band").join(classes.select("key", "sig"), "key")
    small = B.together(small, partitions(classes, told), "band").sortWithinPartitions("band", "key")
    large = rows.join(sizes.filter(F.col("size") > SIDE), "band").select(F.col("key").alias("a"), F.col("first").alias("b"))
    return small.mapInArrow(run, "a bigint, b bigint").unionAll(large)


def unpruned(sigs: np.ndarray, side: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of rows that no step prunes, in pieces; with ``side``, only pairs of different sides."""
    n = len(sigs)
    first, least = sigs[:, :STEP], least_matches(threshold, TOLERANCE, sigs.shape[1])[0]
    per = max(1, _CELLS // (STEP * max(1, n)))
    for x in range(0, n - 1, per):
        rows = np.arange(x, min(x + per, n - 1))
        fine = (first[rows, None] == first[None, x + 1 :]).sum(2, dtype=np.int8) >= least
        fine &= np.arange(x + 1, n)[None, :] > rows[:, None]
        if side is not None:
            fine &= side[rows, None] != side[None, x + 1 :]
        i, j = np.nonzero(fine)
        i, j = rows[i], j + x + 1
        left = survivors(sigs, i, j, threshold)
        if len(left):
            yield i[left], j[left]


def common_shingles(flat: np.ndarray, bounds: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many shingles the sets i[k] and j[k] share."""
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    if len(i) <= 2 * len(used):
        sets = {k: flat[bounds[k] : bounds[k + 1]] for k in used.tolist()}
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], np.int64)
    # many pairs of few sets: a product of 0/1 matrices counts common shingles, columns in pieces
    n, sizes = len(used), (bounds[1:] - bounds[:-1])[used]
    own = np.concatenate([flat[bounds[k] : bounds[k + 1]] for k in used.tolist()])
    _, of, times = np.unique(own, return_inverse=True, return_counts=True)
    shared = times[of] > 1
    rows, column = np.repeat(np.arange(n), sizes)[shared], (np.cumsum(times > 1) - 1)[of[shared]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    width = max(256, min(4096, _CELLS // n))
    common = np.zeros((n, n), np.float32)
    for at_column in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (at_column, at_column + width))
        piece = np.zeros((n, width), np.float32)
        piece[rows[a:b], column[a:b] - at_column] = 1
        common += piece @ piece.T
    return common[at[: len(i)], at[len(i) :]].astype(np.int64)


def verified(members: DataFrame, rows: int, threshold: float, words: int) -> DataFrame:
    """(key, links, root) from (component, blocks, key, copies, sig, text), ``rows`` of them with their
    blocks: per pair of blocks, how many documents of other classes each class is linked to, and the
    forest of those links. Pairs are pruned by ``sig`` and, where they stay, verified by the sets."""
    ratio = Fraction(str(threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, ["component", "lo", "hi"]):
            keys, copies, own, lo, hi = (np.asarray(table.column(c).combine_chunks()) for c in ("key", "copies", "own", "lo", "hi"))
            sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(keys), -1)
            flat, bounds = shingle_sets(B.text_array(table, "text"), words)
            sizes = np.diff(bounds)
            links, label = np.zeros(len(keys), np.int64), np.arange(len(keys))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if b - a < 2:
                    continue
                pairs = [(a + i, a + j) for i, j in unpruned(sigs[a:b], own[a:b] if lo[a] != hi[a] else None, threshold)]
                if not pairs:
                    continue
                i, j = (np.concatenate(x) for x in zip(*pairs))
                common = common_shingles(flat, bounds, i, j)
                fine = common * ratio.denominator >= ratio.numerator * (sizes[i] + sizes[j] - common)
                i, j = i[fine], j[fine]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                label[a:b] = a + forest(b - a, i - a, j - a)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(links[some]), pa.array(keys[label[some]])], ["key", "links", "root"])

    # a group's pairs of blocks go to partitions in turn, so none gets several before all have one
    n = partitions(members, rows)
    slot = F.pmod(F.pmod(F.xxhash64("component"), F.lit(n)) + F.col("pair"), F.lit(n)).cast("int")
    spread = members.repartitionById(n, slot).sortWithinPartitions("component", "lo", "hi", "key")
    return spread.mapInArrow(run, "key bigint, links bigint, root bigint")


def join(df: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, class_id, n_links, n_copies, root) of every row.

    ``n_links`` counts the other rows it is linked to, equal sets included; ``n_copies`` the rows
    with its set, itself included; ``root`` names the class of linked rows (null without a set).
    """
    signed = B.checkpointed(signatures(df, id_col, text_col, words))
    with_set = signed.filter(F.col("key").isNotNull())
    classes = with_set.groupBy("key").agg(F.min(F.struct("id", "text_hash")).alias("pick"), F.min("id").alias("least"), F.count("*").alias("copies"), F.first("chars").alias("chars"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = B.checkpointed(classes)
    near = connected_components(candidate_groups(classes, threshold))
    # what joins on a possibly hot key is written first: then Spark can split the other side
    near = near.join(classes.select(F.col("key").alias("node"), "pick", "copies", "chars", "sig"), "node")
    sizes = B.checkpointed(near.groupBy("root").agg(blocks_of(F.count("*"), F.sum("chars")).alias("blocks"), F.count("*").alias("size")))
    rows, n_asked = (x or 0 for x in sizes.agg(F.sum(F.col("size") * F.col("blocks")), F.sum("size")).first())
    asked = near.join(sizes.drop("size"), "root").select(F.col("node").alias("key"), F.col("root").alias("component"), "blocks", "copies", "sig", "pick.id", "pick.text_hash")
    texts = df.select(F.col(id_col).alias("d_id"), F.xxhash64(text_col).alias("d_hash"), F.col(text_col).alias("text"))
    if n_asked <= BROADCAST_ROWS:  # then only the texts that are asked for are shuffled; beyond it, all of them
        texts = texts.join(F.broadcast(asked.select("text_hash")), F.col("d_hash") == F.col("text_hash"), "left_semi")
    members = asked.join(texts, asked.id.eqNullSafe(texts.d_id) & (asked.text_hash == texts.d_hash))
    # rows equal in id and text both match: one is enough
    members = members.groupBy("key", "component", "blocks", "copies", "sig").agg(F.first("text").alias("text"))
    found = B.checkpointed(verified(block_pairs(members, "component"), rows, threshold, words))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    facts = classes.select("key", "copies", "least").join(links, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    facts = B.checkpointed(facts)
    names = B.checkpointed(facts.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("least").alias("first")))
    facts = facts.join(names, "root", "left").select(
        "key",
        F.coalesce("first", "least").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.col("copies").alias("n_copies"),
        F.coalesce("root", "key").alias("root"),
    )
    out = with_set.select("id", "text_hash", "key").join(facts, "key").drop("key")
    alone = signed.filter(F.col("key").isNull()).select("id", "text_hash", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(None).cast("long").alias("root"))
    return out.unionAll(alone).withColumnRenamed("id", id_col)


def report(joined: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return joined.select(id_col, "class_id", "n_links", "n_copies")


def one_of_each(df: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns kept, with one row of each class of linked rows: the one of the
    smallest id (null first) and, of those, the smallest hash of the text; of rows equal in id and text,
    that with the smallest hash of all columns. Rows without a set stay."""
    found = join(df, threshold, words, id_col, text_col)
    per_row = found.groupBy("root", F.col(id_col).alias("k_id"), F.col("text_hash").alias("k_hash")).agg(F.count("*").alias("k_rows"))
    kept = per_row.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct("k_id", "k_hash", "k_rows")).alias("k")).select("k.*")
    kept = B.checkpointed(kept)
    names = {c: B.own_column(df, c) for c in ("k_id", "k_hash", "k_rows")}
    kept = kept.withColumnsRenamed(names)
    k_id, k_hash, k_rows = names.values()
    same = df[id_col].eqNullSafe(kept[k_id]) & (F.xxhash64(df[text_col]) == kept[k_hash])
    matched = df.join(kept, same).select(*[df[c] for c in df.columns], k_rows)
    once, often = matched.filter(F.col(k_rows) == 1).drop(k_rows), matched.filter(F.col(k_rows) > 1).drop(k_rows)
    blank = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    order = F.xxhash64(*[F.col(c).cast("string") for c in df.columns])
    one = often.groupBy(id_col, F.xxhash64(text_col)).agg(F.min_by(F.struct(*df.columns), order).alias("row")).select("row.*")
    return once.unionAll(one).unionAll(df.filter(blank))
