"""Operator 5: BPE encoding and decoding by prefix-sharing trie traversal.

Encoding equals ``Tokenizer.encode(text, add_special_tokens=False)`` of a word-level BPE with an
end-of-word suffix. A greedy BPE has one property that makes prefixes shareable: the encoding of a
prefix ends in one token, and a token may follow another exactly if merging both again leaves the
two as they are. So the distinct words of a batch form a trie; a depth-first walk carries, for
each prefix, the last token of its encoding, found among the vocabulary's suffixes of that prefix.
What words share is computed once, and a word's tokens are read back along the last tokens.

Defined results: null text is the empty text (no ids, empty decoding); rows are independent, so
repeated rows, null ids and extra columns need no care (only id and text columns are read); an
empty table gives an empty table. Texts are encoded whole.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import _base as B
from panelcast.llm import _text as T

#: Encodings of chunks kept by a worker, rows of an output batch.
MEMO, OUT_ROWS = 2_000_000, 512
#: Beyond these code points, texts are normalised by the tokenizers library itself.
_BEYOND = re.compile("[^\x00-ɏ]")
_SPACE = re.compile("[\t-\r \x85\xa0]+")
_MARKS = tuple(",.;:!?")


class TrieBPE:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.tool = Tokenizer.from_file(path)
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.names = [""] * size
        for t, i in (*self.ids.items(), *self.special.items()):
            self.names[i] = t
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # rank: the merge that makes a token; parts: what it merges
        self.rank = [-1] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.merged: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            pair, t = (self.ids[a], self.ids[b]), self.ids[a + b]
            self.merged[pair] = r
            self.rank[t], self.parts[t] = r, pair
        self.allowed: dict[tuple[int, int], bool] = {}
        own = {t: i for t, i in self.ids.items() if self.parts[i] is None or self.follows(*self.parts[i], self.rank[i])}
        self.inner = {t: i for t, i in own.items() if not t.endswith(self.end)}
        self.final = {t[: -len(self.end)]: i for t, i in own.items() if t.endswith(self.end)}
        # the longest token that ends in three given symbols; where no token does, two is the longest
        self.reach: dict[str, int] = {}
        self.reach_final: dict[str, int] = {}
        for names, reach in ((self.inner, self.reach), (self.final, self.reach_final)):
            for t in names:
                if len(t) > 2:
                    reach[t[-3:]] = max(reach.get(t[-3:], 0), len(t))
        self.coder = T.ChunkCoder(T.word_spans, self.encode_chunks, MEMO)

    def follows(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Whether the merges before ``limit`` leave token a followed by token b apart.

        Both are taken apart again, latest merge first; at each step the pair that then touches
        must not merge earlier than the merge just undone.
        """
        while True:
            r = self.merged.get((a, b))
            if r is not None and r < limit:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            # equal ranks (the same token twice): the left one merges first, so the right is undone first
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            else:
                limit, b = rb + 1, self.parts[b][0]

    def _last(self, text: str, to: int, lasts: list[int], names: dict[str, int], reach: dict[str, int]) -> int:
        allowed = self.allowed
        n = reach.get(text[to - 3 : to], 2) if to > 2 else to
        for n in range(n if n < to else to, 0, -1):
            t = names.get(text[to - n : to])
            if t is None:
                continue
            if n == to:
                return t
            pair = (lasts[to - n], t)
            ok = allowed.get(pair)
            if ok is None:
                ok = allowed[pair] = self.follows(*pair)
            if ok:
                return t
        raise ValueError("the vocabulary lacks a symbol")

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words (in the vocabulary's symbols): a depth-first walk of their trie."""
        out, lasts, before = {}, [0], ""
        if len(self.allowed) > 2_000_000:
            self.allowed.clear()
        for w in sorted(words):  # depth-first order; lasts[d] is the state of the node at depth d
            d = 0
            for x, y in zip(before, w):
                if x != y:
                    break
                d += 1
            d = min(d, len(lasts) - 1)
            del lasts[d + 1 :]
            for to in range(d + 1, len(w)):
                lasts.append(self._last(w, to, lasts, self.inner, self.reach))
            t, at, ids = self._last(w, len(w), lasts, self.final, self.reach_final), len(w), []
            ids.append(t)
            at -= len(self.names[t]) - len(self.end)
            while at:
                t = lasts[at]
                ids.append(t)
                at -= len(self.names[t])
            out[w] = ids[::-1]
            before = w
        return out

    def _pieces(self, text: str) -> list[str]:
        """Normalised and pre-tokenised, in the vocabulary's symbols."""
        if text.isascii() and text.isalpha():
            return [text.lower()]
        if _BEYOND.search(text):
            text = self.tool.normalizer.normalize_str(text)
        else:
            text = _SPACE.sub(" ", text).lower()
        if text[-1:] in _MARKS and text[:-1].isascii() and text[:-1].isalpha():
            return [text[:-1], text[-1]]
        return [p for p, _ in self.tool.pre_tokenizer.pre_tokenize_str(text)]

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of runs of text between white space, by one walk over their pieces' trie."""
        parts: list[list[str | int]] = []
        for c in chunks:
            if "<" in c and self.cut and self.cut.search(c):
                parts.append([x for s in self.cut.split(c) for x in ([self.special[s]] if s in self.special else self._pieces(s))])
            else:
                parts.append(self._pieces(c))
        coded = self.encode_words(list({p for ps in parts for p in ps if isinstance(p, str)}))
        return [coded[ps[0]] if len(ps) == 1 and isinstance(ps[0], str) else [i for p in ps for i in (coded[p] if isinstance(p, str) else (p,))] for ps in parts]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        out = []
        for n, ids, bounds in self.coder.encode(pa.array(texts, pa.string())):
            flat = ids.tolist()
            out += [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return out

    def decode(self, ids: list[int]) -> str:
        """As the tokenizers library does without a decoder: tokens joined by one space."""
        names = self.names
        return " ".join([names[i] for i in ids])


@functools.cache
def coder(path: str) -> TrieBPE:
    return TrieBPE(path)


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every row; ``path`` is a tokenizer file on each host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            done = 0
            for n, flat, bounds in bpe.coder.encode(B.text_array(batch, "text")):
                for at in range(0, n, OUT_ROWS):
                    ends = bounds[at : at + OUT_ROWS + 1]
                    ids = flat[ends[0] : ends[-1]]
                    ends = ends - ends[0]
                    names = ids.tolist()
                    texts = [bpe.decode(names[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                    rows = batch.column("id").slice(done + at, len(ends) - 1)
                    yield pa.RecordBatch.from_arrays([rows, lists, pa.array(texts, pa.string())], ["id", "ids", "decoded"])
                done += n

    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from the operator's ids and decoded texts."""
    return coded.select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
