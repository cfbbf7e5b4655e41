"""Operators 5 and 10 against the tokenizers library and an exact round trip."""

import hashlib
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from panelcast.llm import bpe_trie, token_store  # noqa: E402

PIECES = ["the", "Ing", "é", "é", "Σ", "İ", "\n", " ", "  ", "12", "'s", "'RE", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x00", " ", "東京", "_", "-", "\xa0", "\x85", "ﬁ", "ab" * 9, "zqx", ". ", ", ", "naïve.", "word."]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(25))) for _ in range(n)] + ["".join(rng.choice("etaoinshrdluETA' -.") for _ in range(200)) for _ in range(50)]


def test_trie_encodes_and_decodes_as_the_library():
    bpe = bpe_trie.coder(P.path("word_bpe_49k.json"))
    some = texts(1500, 1)
    for t, mine, want in zip(some, bpe.encode(some), bpe.tool.encode_batch(some, add_special_tokens=False)):
        assert mine == want.ids, t
        assert bpe.decode(mine) == bpe.tool.decode(want.ids, skip_special_tokens=False)


def test_chunks_encode_as_whole_texts():
    tok = token_store.tokenizer(P.path("byte_bpe_50k.json"))
    some = texts(1500, 2)
    for t, mine, want in zip(some, tok.encode(some), tok.tool.encode_batch(some, add_special_tokens=False)):
        assert mine == want.ids, t


def test_forgetting_chunks_changes_nothing():
    from panelcast.llm import _text as T

    bpe = bpe_trie.coder(P.path("word_bpe_49k.json"))
    small = T.ChunkCoder(T.word_spans, bpe.encode_chunks, limit=20, slice_bytes=200)
    import pyarrow as pa

    some = texts(100, 3)
    got = [ids[a:b].tolist() for _, ids, bounds in small.encode(pa.array(some)) for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == bpe.encode(some)


def test_trie_query(docs):
    frame = docs([None, "", "Hello  world's <|endoftext|>", "a " * 5000, (2, "Hello  world's <|endoftext|>"), (None, "x")])
    rows = bpe_trie.digests(bpe_trie.encode_decode(frame, P.path("word_bpe_49k.json"))).collect()
    tool = bpe_trie.coder(P.path("word_bpe_49k.json")).tool
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in frame.collect():
        ids = tool.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(tool.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_empty_tables(docs):
    empty = docs([]) if False else docs(["x"]).filter("false")
    assert bpe_trie.encode_decode(empty, P.path("word_bpe_49k.json")).count() == 0
    assert token_store.roundtrip(empty, P.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("n, top", [(1, 0), (5, 0), (100, 50), (1000, 10**6), (130, 3)])
def test_elias_fano(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    ef = token_store.EliasFano.of(values)
    again = token_store.EliasFano.from_bytes(memoryview(ef.to_bytes()), n, ef.low_bits)
    assert again.all().tolist() == values.tolist()
    assert [again.select(i) for i in range(n)] == values.tolist()
    for bad in (-1, n):
        with pytest.raises(IndexError):
            again.select(bad)
    if n == 1000:
        assert len(ef.to_bytes()) < n * 8 / 4


def test_block_roundtrip():
    docs_ = [np.arange(k, dtype="<u2").tobytes() for k in (3, 0, 5)]
    flat, bounds = token_store.open_block(token_store.pack_block(docs_, 2))
    assert bounds.all().tolist() == [0, 3, 3, 8] and flat.tolist() == [0, 1, 2, 0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        token_store.open_block(b"x" * 100)


def test_store_query(docs, monkeypatch):
    rng = random.Random(4)
    some = [(i * 3 - 40, t) for i, t in enumerate(texts(80, 4))]
    rng.shuffle(some)
    frame = docs([*some, (None, None), (2, "same"), (2, "same")])
    rows = token_store.roundtrip(frame, P.path("byte_bpe_50k.json")).collect()
    tool = token_store.tokenizer(P.path("byte_bpe_50k.json")).tool
    want = sorted([[r.doc_id, [*tool.encode(r.text or "", add_special_tokens=False).ids, 0]] for r in frame.collect()], key=lambda x: (x[0] is not None, x[0] or 0))
    got = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [w[0] for w in want]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == sorted((w[0] is None, w[0] or 0, len(w[1]), crc(w[1])) for w in want)


def test_documents_are_fetched_by_select(monkeypatch):
    rng = np.random.default_rng(4)
    parts = [rng.integers(0, 60_000, n).astype("<u2") for n in (0, 3, 0, 0, 900, 1, *[5] * 200, 70_000)]
    monkeypatch.setattr(token_store.EliasFano, "all", None)
    at, crc = token_store.block_documents(token_store.pack_block([p.tobytes() for p in parts], 2))
    ends = np.cumsum([0, *map(len, parts)])
    assert at.tolist() == np.stack([ends[:-1], ends[1:]], axis=1).tolist()
    assert crc == [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
    empty, none = token_store.block_documents(token_store.pack_block([], 2))
    assert empty.shape == (0, 2) and none == []


def test_very_long_and_awkward_rows(spark, docs):
    """A text longer than a block, empty and null ones, repeated rows, null ids and an empty table."""
    long = " ".join(random.Random(3).choice(PIECES) or "x" for _ in range(200_000))
    rows = [(3, long), (1, None), (2, ""), (5, "twice"), (5, "twice"), (None, "no id")]
    tools = {"byte": token_store.tokenizer(P.path("byte_bpe_50k.json")).tool, "word": bpe_trie.coder(P.path("word_bpe_49k.json")).tool}
    got = token_store.roundtrip(docs(rows), P.path("byte_bpe_50k.json")).collect()
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tools["byte"].encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    out = {r.doc_id: r for r in bpe_trie.digests(bpe_trie.encode_decode(docs(rows), P.path("word_bpe_49k.json"))).collect()}
    for i, t in rows:
        ids = tools["word"].encode(t or "", add_special_tokens=False).ids
        assert out[i].n_tokens == len(ids) and out[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    empty = docs(["x"]).filter("false")
    assert token_store.roundtrip(empty, P.path("byte_bpe_50k.json")).count() == 0
    assert bpe_trie.encode_decode(empty, P.path("word_bpe_49k.json")).count() == 0
