"""Vectorised word splitting and hashing over Arrow string buffers.

Texts stay UTF-8 bytes. Both word definitions of the operators split at ASCII bytes only, so
splitting bytes equals splitting code points:

* ``SPACE``: ``[^\\x20\\x09-\\x0D]+``, unchanged;
* ``ALNUM``: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

A word's hash is a polynomial over a random byte substitution modulo 2**64, mixed with the word's
length. Work goes in pieces of about one megabyte (more only for a single longer word).
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

U = np.uint64


def _steady_memory() -> None:
    """Let the C library give large freed arrays back at once.

    By default its threshold for that rises with use, and arrays that grow a little at each step
    then leave holes nothing fits into: a worker's memory grew by hundreds of megabytes.
    """
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps its own rules
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


if TaskContext.get() is not None:  # in workers only: the driver's process is its user's
    _steady_memory()
PIECE = 1 << 20
#: Words are hashed in pieces of this size: their arrays stay in the cache, and below the threshold for mappings.
HASHED = 1 << 16

SPACE, ALNUM = "space", "alnum"


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    with np.errstate(over="ignore"):
        y = x >> U(30)
        y ^= x
        y *= U(0xBF58476D1CE4E5B9)
        y ^= y >> U(27)
        y *= U(0x94D049BB133111EB)
        y ^= y >> U(31)
        return y


def salted(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0x632BE59BD9B4E019 % 2**64))


@functools.cache
def tables(kind: str, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(is word byte, substitution) by byte value."""
    b = np.arange(256)
    low = b.copy()
    if kind == SPACE:
        word = ~((b == 0x20) | ((b >= 0x09) & (b <= 0x0D)))
    else:
        low = np.where((b >= 65) & (b <= 90), b + 32, b)
        word = (b >= 0x80) | ((low >= 97) & (low <= 122)) | ((b >= 48) & (b <= 57))
    return word, salted(seed, 256)[low]


@functools.cache
def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    with np.errstate(over="ignore"):
        out = np.full(n, base, dtype=U)
        out[0] = 1
        return np.multiply.accumulate(out, out=out)


BASE = 0x9E6D62D06F6A9A9B
INVERSE = pow(BASE, -1, 2**64)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def _pieces(data: np.ndarray, offsets: np.ndarray, word: np.ndarray, size: int):
    """(first, last) byte ranges of about ``size`` bytes that no word crosses; texts' starts end words too."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = at + size
        if to < end:
            start = int(offsets[np.searchsorted(offsets, to)])
            while to < start:
                found = np.flatnonzero(~word[data[to : min(to + 4096, start)]])
                if len(found):
                    to += int(found[0])
                    break
                to = min(to + 4096, start)
        yield at, min(to, end)
        at = min(to, end)


def _span_hashes(piece: np.ndarray, sub: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = max(2 * HASHED, 1 << len(piece).bit_length())  # few sizes: the powers are kept
    with np.errstate(over="ignore"):
        sums = np.zeros(len(piece) + 1, U)
        np.cumsum(sub[piece] * powers(BASE, n)[: len(piece)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * powers(INVERSE, n)[starts]
        return mix(h ^ ((ends - starts).astype(U) * U(0xD6E8FEB86659FD93)))


def _first(offsets: np.ndarray, a: int, b: int) -> np.ndarray:
    """Where in bytes a:b a text starts."""
    out = np.zeros(b - a, bool)
    out[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a] = True
    return out


def word_hashes(texts: pa.Array, kind: str = SPACE, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, bounds): text i has the words bounds[i]:bounds[i+1]; other seeds, other hashes."""
    hashes, bounds, _, _ = word_spans(texts, kind, seed)
    return hashes, bounds


def word_spans(texts: pa.Array, kind: str = SPACE, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``word_hashes`` and each word's first byte and end in the texts' buffer."""
    word, sub = tables(kind, seed)
    data, offsets = buffers(texts)
    found, places, stops = [], [], []
    for a, b in _pieces(data, offsets, word, HASHED):
        piece = data[a:b]
        is_word, first = word[piece], _first(offsets, a, b)
        # a word starts after a non-word byte or at a text's start, and ends before either
        edge = first.copy()
        edge[1:] |= ~is_word[:-1]
        edge[0] = True
        starts = np.flatnonzero(is_word & edge)
        after = np.ones(b - a, bool)
        after[:-1] = ~is_word[1:] | first[1:]
        ends = np.flatnonzero(is_word & after) + 1
        found.append(_span_hashes(piece, sub, starts, ends))
        places.append(starts + a)
        stops.append(ends + a)
    if not found:
        return np.zeros(0, U), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate(places)
    return np.concatenate(found), np.searchsorted(starts, offsets).astype(np.int64), starts, np.concatenate(stops)


@functools.cache
def _joint_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes that may stand before a joint, two before it if a continuation byte does, and after it.

    A joint is a space between two characters that are surely no white space; Unicode's other white
    space starts with C2, E1, E2 or E3, or ends in a continuation byte after C2, 80, 81 or 9A.
    """
    b = np.arange(256)
    ascii_ok = (b > 0x20) & (b < 0x7F)
    after = ascii_ok | ((b >= 0xC3) & (b <= 0xDF)) | (b >= 0xE4)
    return ascii_ok, (b >= 0x80) & ~np.isin(b, (0xC2, 0x80, 0x81, 0x9A)), after


def joint_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_spans``, of chunks: texts cut before every joint, nothing left out."""
    before, two_before, after = _joint_tables()
    data, offsets = buffers(texts)
    found, places, stops = [], [], []
    sub = salted(11, 256)
    for a, b in _pieces(data, offsets, np.ones(256, bool), PIECE):
        piece = data[a:b]
        ok = np.zeros(b - a, bool)
        space = np.flatnonzero(piece == 0x20)
        space = space[(space > 1) & (space < b - a - 1)]
        ok[space] = (before[piece[space - 1]] | ((piece[space - 1] >= 0x80) & two_before[piece[space - 2]])) & after[piece[space + 1]]
        first = _first(offsets, a, b)
        first[0] = True
        ok[space] &= ~first[space] & ~first[space - 1] & ~first[space + 1]
        starts = np.flatnonzero(ok | first)
        ends = np.append(starts[1:], b - a)
        found.append(_span_hashes(piece, sub, starts, ends))
        places.append(starts + a)
        stops.append(ends + a)
    if not found:
        return np.zeros(0, U), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate(places)
    return np.concatenate(found), np.searchsorted(starts, offsets).astype(np.int64), starts, np.concatenate(stops)


class ChunkCoder:
    """Ids of texts cut into chunks, each distinct chunk encoded once and remembered.

    ``learn`` maps chunks to their ids. Chunks are told apart by 64-bit hashes; of ``limit``
    remembered chunks, two differing ones share a hash with a chance of limit**2 / 2**65.
    """

    def __init__(self, spans, learn, limit: int, slice_bytes: int = 4 << 20) -> None:
        self.spans, self.learn, self.limit, self.slice_bytes = spans, learn, limit, slice_bytes
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, U)  # sorted; chunk keys[i] is entry at[i]
        self.at = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)  # entry i has pool[ends[i]:ends[i + 1]]
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _add(self, keys: np.ndarray, coded: list[list[int]]) -> None:
        ends = self.used + np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
        to = int(ends[-1])
        if to > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(to + to // 4 - self.used, np.int32)])
        self.pool[self.used : to] = np.fromiter(chain.from_iterable(coded), np.int32, to - self.used)
        new = np.arange(len(self.ends) - 1, len(self.ends) - 1 + len(coded), dtype=np.int32)
        self.ends, self.used = np.concatenate([self.ends, ends]), to
        both = np.concatenate([self.keys, keys])
        order = np.argsort(both, kind="stable")  # merges two sorted runs
        self.keys, self.at = both[order], np.concatenate([self.at, new])[order]

    def encode(self, texts: pa.Array):
        """Yields (number of texts, ids, bounds) for consecutive runs of texts."""
        _, offsets = buffers(texts)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + self.slice_bytes, "right")) - 1)
            yield self._run(texts.slice(at, to - at))
            at = to

    def _known(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def _run(self, texts: pa.Array) -> tuple[int, np.ndarray, np.ndarray]:
        hashes, bounds, starts, ends = self.spans(texts)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if not len(distinct):
            return len(texts), np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        if len(self.keys) > self.limit:
            self._clear()
        missing = np.flatnonzero(~self._known(distinct))
        if len(missing):
            data, _ = buffers(texts)
            spans = zip(starts[where[missing]].tolist(), ends[where[missing]].tolist())
            self._add(distinct[missing], self.learn([data[a:b].tobytes().decode() for a, b in spans]))
        e = self.at[np.searchsorted(self.keys, distinct)][inverse]
        first = self.ends[e]
        sizes = self.ends[e + 1] - first
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(first - total[:-1], sizes) + np.arange(total[-1])]
        return len(texts), ids, total[bounds]


def window_hashes(words: np.ndarray, bounds: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window of k consecutive words of one text, its first word's place)."""
    n = len(words)
    if n < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    places = np.arange(n - k + 1)
    last = np.repeat(bounds[1:], np.diff(bounds))[: n - k + 1]
    keep = places + k <= last
    mults = salted(seed, k) | U(1)
    with np.errstate(over="ignore"):
        out = words[: n - k + 1] * mults[0]
        if k <= 8:
            for j in range(1, k):
                out += words[j : n - k + 1 + j] * mults[j]
        else:  # one pass of prefix sums instead of k
            base, size = int(mults[1]), max(PIECE, 1 << n.bit_length())
            sums = np.zeros(n + 1, U)
            np.cumsum(mix(words ^ U(seed)) * powers(base, size)[:n], out=sums[1:])
            out = (sums[k:] - sums[: n - k + 1]) * powers(pow(base, -1, 2**64), size)[: n - k + 1]
    return mix(out)[keep], places[keep]
