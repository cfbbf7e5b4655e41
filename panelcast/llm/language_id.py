"""Operator 6: language identification with bit-sliced Bloom filters.

One table of cells, each a bit mask with a bit a language: language l's Bloom filter is the slice
of bit l. Two cells of an n-gram (five UTF-8 bytes, A-Z lower-cased, other ASCII than letters taken
as spaces) are read and intersected, which answers for all languages at once. A text's count for a
language is the number of its n-grams with that bit, corrected for the filter's false-positive
rate; the largest corrected share decides, ties going to the language with more training rows.

Training takes at most ``sample`` documents a language, those with the smallest hash of their id
among the rows ``train`` selects (the documented bound); their whole texts are used and every n-gram of
them is kept. The filters' size follows the language with the most distinct n-grams, so that no filter's
false-positive rate exceeds ``FALSE_RATE``. Executors build the filters; the driver receives and sends on
2**bits cells, at most 32 a distinct n-gram of that sample, of a bit a language.

Defined results: text null or without a letter gives ``und`` and score 0; a text without any known
n-gram gets the most frequent training language with score 0; without training rows every
prediction is ``und``. Rows are judged one by one, so repeated rows and null ids need no care; an empty
table gives an empty table; a very long text is read in slices of bounded size.
``lang``, ``source`` and ids are never inputs of a prediction. Texts are read whole.
"""

from __future__ import annotations

import functools
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm import _base as B
from panelcast.llm._text import mix

UND = "und"
GRAM = 5
#: What a filter takes for known at most though it never met it; a filter's least size.
FALSE_RATE, LEAST_BITS = 0.02, 16
#: A text is in a language if that language knows at least this part of its n-grams.
KNOWN = 0.25
SLICE = 1 << 19
_LETTER = regex.compile(r"\p{L}")


@functools.cache
def _fold() -> np.ndarray:
    b = np.arange(256)
    low = np.where((b >= 65) & (b <= 90), b + 32, b)
    return np.where((low >= 97) & (low <= 122) | (low >= 128), low, 32).astype(np.uint8)


def grams(text: bytes) -> Iterator[np.ndarray]:
    """64-bit codes of a text's n-grams, in bounded slices; those of spaces alone are left out."""
    padded = b"  " + text + b"  "
    for at in range(0, max(1, len(padded) - GRAM + 1), SLICE):
        part = _fold()[np.frombuffer(padded, np.uint8, min(SLICE + GRAM - 1, len(padded) - at), at)].astype(np.uint64)
        n = len(part) - GRAM + 1
        if n < 1:
            return
        codes = np.zeros(n, np.uint64)
        for j in range(GRAM):
            codes |= part[j : n + j] << np.uint64(8 * j)
        yield codes[codes != np.uint64(0x2020202020)]


def cells(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(codes)
    mask = np.uint64((1 << bits) - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def bits_for(n: int) -> int:
    """The smallest filter (in bits of a cell's number) that keeps ``FALSE_RATE`` with n n-grams of two cells each."""
    least = 2 * n / -np.log1p(-(FALSE_RATE**0.5))
    return min(32, max(LEAST_BITS, int(np.ceil(np.log2(max(1, least))))))


@dataclass
class Filters:
    """langs in order of training rows; masks[cell, word] has bit l % 64 of word l // 64 for language l."""

    langs: list[str]
    masks: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def of(cls, langs: list[str], filters: list[bytes]) -> Filters:
        words = -(-len(langs) // 64) or 1
        kind = np.dtype(f"u{next(w for w in (1, 2, 4, 8) if len(langs) <= 8 * w or w == 8)}")
        masks = np.zeros((8 * len(filters[0]) if filters else 1, words), kind)
        rate = np.zeros(len(langs))
        for i, packed in enumerate(filters):
            bits = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")
            masks[:, i // 64] |= bits.astype(kind) << kind.type(i % 64)
            rate[i] = bits.mean() ** 2
        return cls(langs, masks, rate)

    @property
    def bits(self) -> int:
        return len(self.masks).bit_length() - 1

    def counts(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For texts with codes[bounds[i]:bounds[i+1]], how many n-grams each language's slice holds."""
        a, b = cells(codes, self.bits)
        out = np.zeros((len(bounds) - 1, len(self.langs)), np.int64)
        full = np.flatnonzero(np.diff(bounds))
        if not len(full):
            return out
        both = self.masks[a] & self.masks[b]
        for i in range(len(self.langs)):
            kind = both.dtype.type
            bit = (both[:, i // 64] >> kind(i % 64)) & kind(1)
            out[full, i] = np.add.reduceat(bit, bounds[:-1][full], dtype=np.int64)
        return out

    def decide(self, counts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, share of the corrected counts, part of the n-grams that language knows)."""
        fixed = np.maximum(counts - self.false_rate * n[:, None], 0) / (1 - self.false_rate)
        total, best = fixed.sum(1), fixed.argmax(1)
        most = fixed[np.arange(len(best)), best]
        return best, np.where(total > 0, most / np.where(total > 0, total, 1), 0.0), np.where(n > 0, most / np.maximum(n, 1), 0.0)


def distinct_grams(texts: list[str]) -> np.ndarray:
    """All n-grams of some texts, sorted."""
    out = np.zeros(0, np.uint64)
    held, size = [], 0
    for t in texts:
        for codes in grams(t.encode()):
            held.append(np.unique(codes))
            size += len(held[-1])
            if size > max(4 * SLICE, len(out)):
                out, held, size = np.unique(np.concatenate([out, *held])), [], 0
    return np.unique(np.concatenate([out, *held]))


def build_filter(codes: np.ndarray, bits: int) -> bytes:
    """A Bloom filter of some n-grams."""
    own = np.zeros(1 << bits, np.uint8)
    for c in cells(codes, bits):
        own[c] = 1
    return np.packbits(own, bitorder="little").tobytes()


def fit(df: DataFrame, train: Column, sample: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from at most ``sample`` labelled rows a language (see the module's text)."""
    rows = df.filter(train & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), B.place_of(F.col(id_col), F.col(text_col)).alias("h"))
    sizes = dict(map(tuple, rows.groupBy("lang").count().collect()))  # a number a language
    count = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, float(n))]), F.col("lang")) if sizes else F.lit(0.0)
    first = Window.partitionBy("lang").orderBy("h", "text")
    picked = rows.filter(B.among_smallest(F.col("h"), sample, count)).withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= sample).select("lang", "text")

    def learn(table: pa.Table) -> pa.Table:
        codes = distinct_grams(B.text_array(table, "text").to_pylist())
        return pa.table({"lang": table.column("lang").slice(0, 1), "n": pa.array([len(codes)], pa.int64()), "codes": pa.array([codes.tobytes()], pa.binary())})

    learned = B.checkpointed(picked.groupBy("lang").applyInArrow(learn, "lang string, n bigint, codes binary"))
    bits = bits_for(learned.agg(F.max("n")).first()[0] or 0)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [build_filter(np.frombuffer(c.as_py(), np.uint64), bits) for c in batch.column("codes")]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(made, pa.binary())], ["lang", "bits"])

    built = learned.select("lang", "codes").mapInArrow(build, "lang string, bits binary").collect()
    built.sort(key=lambda r: (-sizes.get(r[0], 0), r[0]))
    return Filters.of([r[0] for r in built], [bytes(r[1]) for r in built])


class _Judge:
    def __init__(self, filters: Filters) -> None:
        self.filters = filters

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float], np.ndarray]:
        """(languages, scores, part of the n-grams that language knows)."""
        f = self.filters
        counts = np.zeros((len(texts), len(f.langs)), np.int64)
        n = np.zeros(len(texts), np.int64)
        held, where, size = [], [], 0

        def count() -> None:
            bounds = np.concatenate([[0], np.cumsum([len(c) for c in held])])
            if bounds[-1]:
                np.add.at(counts, where, f.counts(np.concatenate(held), bounds))
                np.add.at(n, where, np.diff(bounds))

        und = np.ones(len(texts), bool)
        for i, t in enumerate(texts):
            if not f.langs or not t or not _LETTER.search(t):
                continue
            und[i] = False
            for c in grams(t.encode()):
                held.append(c)
                where.append(i)
                size += len(c)
                if size >= SLICE:
                    count()
                    held, where, size = [], [], 0
        count()
        if not f.langs:
            return [UND] * len(texts), [0.0] * len(texts), np.zeros(len(texts))
        best, score, known = f.decide(counts, n)
        return [UND if u else f.langs[b] for u, b in zip(und, best)], np.where(und, 0.0, score).tolist(), np.where(und, 0.0, known)


def predict(df: DataFrame, filters: Filters, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` of every row with ``lang_pred``, ``score`` and ``known``, the part of its n-grams that language has."""
    shared = df.sparkSession.sparkContext.broadcast(filters)  # bounded, see the module's text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                langs, scores, known = judge.texts(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(known)], [*id_cols, "lang_pred", "score", "known"])

    # columns are told apart by place: their names may clash in any way
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_cols)
    return df.select(*id_cols, F.col(text_col).alias(B.own_column(df, "text_"))).mapInArrow(run, f"{schema}, lang_pred string, score double, known double")


def drop_rejected(df: DataFrame, filters: Filters, wanted: Collection[str] | None = None, least_known: float = KNOWN, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns kept, whose predicted language is one of ``wanted`` (all learned
    ones by default) and knows at least ``least_known`` of the text's n-grams: texts in none of
    them, null ones and those without a letter go."""
    kinds = [f.dataType.simpleString() for f in df.schema.fields]
    shared, place, names = df.sparkSession.sparkContext.broadcast(filters), df.columns.index(text_col), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                langs, _, known = judge.texts(part.column(place).to_pylist())
                yield part.filter(pa.array([x != UND and k >= least_known and (wanted is None or x in wanted) for x, k in zip(langs, known.tolist())], pa.bool_()))

    return df.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in zip(names, kinds)))
