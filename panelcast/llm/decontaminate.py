"""Operator 9: benchmark decontamination, in DataFrame functions only.

Benchmark items are normalised to words (A-Z lower-cased, then
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) and cut into windows of ``WINDOW`` words; an item of fewer
words is one window. The windows' hashes are broadcast if they, their words and their items measure at
most ``BROADCAST_BYTES``, and joined by shuffle beyond that. One scan of the documents generates every
window of every size the benchmark has, with its own words and nothing else of the text; its hash is
looked up and the words themselves are compared. On the broadcast path only hits, and one row a
document, are shuffled; on the other what is shuffled grows in proportion to the words.

Defined results: null has no words, so it is never hit; an item without words never occurs; rows
equal in id and text stay as many rows and get equal results; an empty benchmark leaves every
document clean; other columns are not read, whatever their names. Texts are scanned whole; of a very
long one, the array of its words is held once, and a task holds the hits of one document at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm import _base as B

WINDOW = 8
#: What is broadcast measures at most this much as text; the driver holds a few times as much.
BROADCAST_BYTES = 32 << 20
_ASCII = [chr(i) for i in range(128)]
_OTHER = "".join(c for c in _ASCII if not ("a" <= c <= "z" or "0" <= c <= "9"))
_FOLDED = "".join(c.lower() if "A" <= c <= "Z" else " " for c in _OTHER)
#: The same words before lower-casing, and what stands between them.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _OTHER, _FOLDED), " "), "")


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(size, gram, hash, items): every distinct window and the sorted ids of its items."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("size", F.least(F.size("w"), F.lit(WINDOW)))
    w = w.select("item", "size", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    w = w.select("item", "size", F.slice("w", F.col("at"), F.col("size")).alias("gram"))
    return w.groupBy("size", "gram").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("hash", F.xxhash64("gram"))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, rows, n_words, found, items) per distinct (id, text).

    ``rows`` counts its repetitions, ``found`` is the sorted array of (at, size) of windows that
    occur (places from 1), ``items`` the sorted distinct ids of their items.
    """
    grams = B.checkpointed(windows(benchmark))
    text_bytes = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 16)
    told = grams.agg(F.collect_set("size"), F.sum(text_bytes(F.col("gram")) + text_bytes(F.col("items")) + 32)).first()
    sizes, small = sorted(told[0]), (told[1] or 0) <= BROADCAST_BYTES  # at most WINDOW sizes
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("w"))
    # size 0 at place 0 stands for the document itself
    rows = base.select("id", "text_hash", "w", F.explode(F.array(*map(F.lit, (0, *sizes)))).alias("size"))
    places = F.when(F.col("size") == 0, F.array(F.lit(0))).when(F.size("w") >= F.col("size"), F.sequence(F.lit(1), F.size("w") - F.col("size") + 1))
    rows = rows.select("id", "text_hash", "w", "size", F.explode(places).alias("at"))
    rows = rows.select("id", "text_hash", "size", "at", F.when(F.col("at") == 0, F.size("w")).alias("n"), F.when(F.col("at") > 0, F.slice("w", F.greatest("at", F.lit(1)), F.col("size"))).alias("own"))
    # documents get a key of their own, so that rows without a window do not meet in one task
    rows = rows.withColumn("h", F.when(F.col("at") > 0, F.xxhash64("own")).otherwise(F.xxhash64("id", "text_hash")))
    side = grams.select(F.col("size").alias("g_size"), "hash", "gram", F.col("items").alias("its"))
    joined = rows.join(F.broadcast(side) if small else side, (rows.h == side.hash) & (rows["size"] == side.g_size), "left")
    joined = joined.withColumn("hit", F.col("own") == F.col("gram")).filter((F.col("at") == 0) | F.col("hit"))
    every = joined.select("id", "text_hash", "n", F.when(F.col("hit"), F.struct("at", "size")).alias("mark"), F.when(F.col("hit"), F.col("its")).alias("its"))
    return every.groupBy("id", "text_hash").agg(
        F.count("n").alias("rows"),
        F.max("n").cast("long").alias("n_words"),
        F.sort_array(F.collect_set("mark")).alias("found"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("its")))).alias("items"),
    )


def covered(found: Column) -> Column:
    """How many words the windows cover: each adds what lies past the furthest end so far."""
    start = F.struct(F.lit(1).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        end = x["at"] + x["size"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(end - F.greatest(acc["end"], x["at"]), F.lit(0))).alias("n"))

    return F.aggregate(found, start, step, lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns, one row a row of ``docs``."""
    found = hits(docs, benchmark, id_col, text_col)
    rows = found.select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_row"))
    n_items = F.size("items").cast("long")
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        covered(F.col("found")).alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_items >= min_items).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without benchmark passages: rows with ``min_items`` items or more go; from rows with
    fewer, the hit words go with what separates them from the next word. Untouched rows stay as they
    are, with all columns."""
    found = hits(docs, benchmark, id_col, text_col).filter(F.size("items") > 0)
    found = found.select(F.col("id").alias("_hit_id"), F.col("text_hash").alias("_hit_text"), F.col("found").alias("_hit_found"), (F.size("items") >= min_items).alias("_hit_drop"))
    taken = {c: B.own_column(docs, c) for c in found.columns}
    found = found.withColumnsRenamed(taken)
    f_id, f_text, f_found, f_drop = taken.values()
    joined = docs.join(found, docs[id_col].eqNullSafe(found[f_id]) & (F.xxhash64(docs[text_col]) == found[f_text]), "left")
    kept = joined.filter(~F.coalesce(F.col(f_drop), F.lit(False)))
    parts = F.regexp_extract_all(docs[text_col], F.lit(f"({_WORD}+)({_GAP}*)"), 0)
    inside = lambda i: F.exists(F.col(f_found), lambda x: (x["at"] <= i + 1) & (i + 1 < x["at"] + x["size"]))
    rest = F.array_join(F.filter(parts, lambda _, i: ~inside(i)), "")
    cut = F.concat(F.regexp_extract(docs[text_col], f"^{_GAP}*", 0), rest)
    text = F.when(F.col(f_found).isNull(), docs[text_col]).otherwise(cut)
    return kept.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
