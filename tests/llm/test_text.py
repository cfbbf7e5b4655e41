import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcast.llm import _blocks as K
from panelcast.llm import _text as T

PATTERNS = {T.SPACE: r"[^\x20\x09-\x0D]+", T.ALNUM: r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"}


def words(text, kind):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text) if kind == T.ALNUM else text
    return re.findall(PATTERNS[kind], low)


@pytest.mark.parametrize("kind", list(PATTERNS))
def test_word_hashes_tell_words_apart(kind):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB é\n\t.0ü,\x1c\x85\xa0東") for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["", "x" * (3 * T.PIECE) + " y " + "é" * 9, " ", "end"]
    arr = pa.array([*texts, "cut"]).slice(0, len(texts))
    hashes, bounds = T.word_hashes(arr, kind)
    want = [words(t, kind) for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in want]
    seen = {}
    for w, h in zip((w for ws in want for w in ws), hashes.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("k", [1, 3, 8, 9, 35])
def test_windows_equal_their_words(k):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    hashes, bounds = T.word_hashes(pa.array(texts))
    got, places = T.window_hashes(hashes, bounds, k, 9)
    want = [(b + i, tuple(ws[i : i + k])) for b, ws in zip(bounds, (t.split() for t in texts)) for i in range(len(ws) - k + 1)]
    assert places.tolist() == [p for p, _ in want]
    names = {}
    for h, (_, w) in zip(got.tolist(), want):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63)))
def test_varints(values):
    v = np.array(values, np.uint64)
    assert K.integers(K.varints(v)).tolist() == values
    assert K.sums(K.differences(np.sort(v))).tolist() == sorted(values)


def test_buckets_are_ranges():
    keys = np.sort(T.salted(1, 1000))
    at = K.cuts(keys, 7, 64)
    assert at[0] == 0 and at[-1] == 1000 and (np.diff(at) > 90).all()
    small = np.arange(1 << 16, dtype=np.uint64)
    assert np.diff(K.cuts(small, 5, 16)).min() > 13000


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**40)), max_size=40), st.integers(0, 60))
@settings(max_examples=200, deadline=None)
def test_counted_keys_survive(pairs, shift):
    kept = sorted({k >> shift: c for k, c in pairs}.items())
    keys, counts = np.array([k for k, _ in kept], np.uint64), np.array([c for _, c in kept], np.int64)
    back = K.keys_counted(K.counted_keys(keys, counts))
    assert back[0].tolist() == keys.tolist() and back[1].tolist() == counts.tolist()


def test_counted_keys_are_short():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 200_000, dtype=np.uint64))
    assert len(K.counted_keys(keys, np.ones(len(keys), np.int64))) < 7 * len(keys)
