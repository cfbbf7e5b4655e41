"""Operator 7: substring dedup with a count-min prefilter.

A window is ``WINDOW`` consecutive words (``[^\\x20\\x09-\\x0D]+``) of one document. First pass: each
block of documents sketches its windows in a count-min sketch of two rows; the sketches are merged,
range by range of the cells, over the cluster. A merged cell never counts less than any window in
it, so a window with a cell of 1 is surely alone. Only the others, estimated repeated, are grouped
exactly in the second pass, by 128-bit hashes of their words. Words covered by a window
that occurs again, in the same document or another, are removed. As only "one or more" matters,
cells saturate at two. The sketch's width follows the input, so it works alike at every size.

A window that does not repeat is taken for one that does if another one shares its 128-bit hash: for n
windows the chance of any error is about n**2 / 2**129, below 10**-12 at 10**13 windows.

Defined results: null text has no words; texts of fewer words than a window lose nothing; rows equal
in id and text repeat each other's windows (a block keeps two of them and answers for all); an empty
table gives an empty table; of a very long text a block holds some 60 bytes a word at once. Texts are
read whole and only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import _base as B
from panelcast.llm import _blocks as K
from panelcast.llm import _text as T

WINDOW = 35


class Plan:
    """The numbers all passes share."""

    def __init__(self, window: int, n: int, bits: int) -> None:
        self.window, self.n, self.bits = window, n, bits

    def windows(self, table: pa.Table, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window hashes, first words, bounds of the texts' words)."""
        words, bounds = T.word_hashes(large_texts(table), T.SPACE, seed)
        hashes, places = T.window_hashes(words, bounds, self.window, seed + 24)
        return hashes, places, bounds

    def rows(self, hashes: np.ndarray) -> list[np.ndarray]:
        """The cell of every window in each row of the sketch."""
        shift = np.uint64(64 - self.bits)
        return [T.mix(hashes ^ np.uint64(seed)) >> shift for seed in (0x51ED270B, 0xA3C59AC3)]

    def key(self, hashes: np.ndarray) -> np.ndarray:
        return T.mix(hashes ^ np.uint64(0x2545F4914F6CDD1D))

    def suspected(self, table: pa.Table, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys[window, half] of the windows estimated repeated, their first words, bounds)."""
        hashes, places, bounds = self.windows(table)
        flags = {(k, b): raw for k, b, raw in zip(K.cells(replies, "kind"), K.cells(replies, "bucket"), K.cells(replies, "body"))}
        keep = np.ones(len(hashes), bool)
        for r, cell in enumerate(self.rows(hashes)):
            distinct, inverse = np.unique(cell, return_inverse=True)
            at = K.cuts(distinct, self.n, self.bits)
            more = [np.unpackbits(np.frombuffer(flags[r, b], np.uint8), count=int(at[b + 1] - at[b])) for b in range(self.n) if at[b + 1] > at[b]]
            if more:
                keep &= np.concatenate(more).astype(bool)[inverse]
        more, _, _ = self.windows(table, 12)
        return np.stack([self.key(hashes[keep]), more[keep]], axis=1), places[keep], bounds


def distinct_keys(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys[., half], the number of each row's key, how often or with what weight each occurs)."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    ordered = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(1)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return ordered[new], of, np.bincount(of, weights=weights, minlength=int(new.sum()))


def large_texts(table: pa.Table) -> pa.Array:
    """The texts of a block as one array, whatever they measure."""
    return B.text_array(table.set_column(table.column_names.index("text"), "text", table.column("text").cast(pa.large_string())), "text")


def twice_at_most(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """(rows, each original row's row): of rows equal in id and text two stay, as a count above one is one."""
    distinct, times, of = K.collapsed(table)
    if (times == 1).all():
        return distinct, of
    more = np.flatnonzero(times > 1)
    return pa.concat_tables([distinct, distinct.take(pa.array(more))]).combine_chunks(), of


_MESSAGE = "bucket bigint, block bigint, kind int, body binary"
_REPLY = "block bigint, bucket bigint, kind int, body binary"


def _table(columns: dict[str, list], order: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.table({n: pa.array(columns[n], kinds[k]) for n, k in (f.split() for f in order.split(", "))})


def _block(table: pa.Table) -> int:
    return table.column("block")[0].as_py()


def _sketch(plan: Plan, table: pa.Table) -> pa.Table:
    """A block's sketch: per row and bucket its cells in order, twice if counted more than once."""
    hashes, _, _ = plan.windows(twice_at_most(table)[0])
    out = {"bucket": [], "block": [], "kind": [], "body": []}
    for r, cell in enumerate(plan.rows(hashes)):
        distinct, times = np.unique(cell, return_counts=True)
        at = K.cuts(distinct, plan.n, plan.bits)
        for b in np.flatnonzero(np.diff(at)).tolist():
            part = slice(at[b], at[b + 1])
            out["bucket"].append(b)
            out["block"].append(_block(table))
            out["kind"].append(r)
            out["body"].append(K.differences(np.repeat(distinct[part], np.minimum(times[part], 2))))
    return _table(out, _MESSAGE)


def _merge(plan: Plan, table: pa.Table) -> pa.Table:
    """Per row of one bucket: add the blocks' cells; answer with a bit for each of a block's cells."""
    out = {"block": [], "bucket": [], "kind": [], "body": []}
    kinds, blocks, bodies = (K.cells(table, c) for c in ("kind", "block", "body"))
    for r in (0, 1):
        own = [i for i, k in enumerate(kinds) if k == r]
        sent = [K.sums(bodies[i]) for i in own]
        if not sent:
            continue
        every = np.sort(np.concatenate(sent))
        twice = every[1:][every[1:] == every[:-1]]
        for i, cells in zip(own, sent):
            mine = np.unique(cells)
            out["block"].append(blocks[i])
            out["bucket"].append(table.column("bucket")[0].as_py())
            out["kind"].append(r)
            out["body"].append(np.packbits(_in(mine, twice)).tobytes())
    return _table(out, _REPLY)


def _in(keys: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(keys), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, keys), len(sorted_set) - 1)] == keys


def _candidates(plan: Plan, table: pa.Table, replies: pa.Table) -> pa.Table:
    """The keys of a block's suspected windows, twice if they occur more than once in it."""
    if not table.num_rows:
        return _table({"bucket": [], "block": [], "kind": [], "body": []}, _MESSAGE)
    keys, _, _ = plan.suspected(twice_at_most(table)[0], replies)
    distinct, _, times = distinct_keys(keys)
    at = K.cuts(distinct[:, 0], plan.n, 64)
    out = {"bucket": [], "block": [], "kind": [], "body": []}
    for b in np.flatnonzero(np.diff(at)).tolist():
        part = slice(at[b], at[b + 1])
        out["bucket"].append(b)
        out["block"].append(_block(table))
        out["kind"].append(2)
        out["body"].append(np.packbits(times[part] > 1).tobytes() + distinct[part].tobytes())
    return _table(out, _MESSAGE)


def _unpack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(body) * 8 // 129  # n bits, rounded up to bytes, and n keys of 16 bytes
    while -(-n // 8) + 16 * n > len(body):
        n -= 1
    head = len(body) - 16 * n
    return np.frombuffer(body, np.uint64, 2 * n, head).reshape(n, 2), np.unpackbits(np.frombuffer(body, np.uint8, head), count=n).astype(bool)


def _group(plan: Plan, table: pa.Table) -> pa.Table:
    """Group one bucket's keys exactly; answer with a bit for each of a block's keys: it repeats."""
    sent = [_unpack(x) for x in K.cells(table, "body")]
    keys, more = np.concatenate([k for k, _ in sent]), np.concatenate([m for _, m in sent])
    _, of, times = distinct_keys(keys, 1.0 + more)
    repeats, ends, n = (times > 1)[of], np.cumsum([len(k) for k, _ in sent]).tolist(), len(sent)
    return _table(
        {"block": K.cells(table, "block"), "bucket": K.cells(table, "bucket"), "kind": [2] * n, "body": [np.packbits(repeats[e - len(k) : e]).tobytes() for e, (k, _) in zip(ends, sent)]},
        _REPLY,
    )


def _remove(plan: Plan, schema: pa.Schema, table: pa.Table, replies: pa.Table) -> pa.Table:
    """Cover the words of repeated windows and keep the others."""
    if not table.num_rows:
        return schema.empty_table()
    table, row_of = twice_at_most(table)
    kind = np.array(K.cells(replies, "kind"))
    keys, places, bounds = plan.suspected(table, replies.filter(pa.array(kind < 2)))
    distinct, inverse, _ = distinct_keys(keys)
    at = K.cuts(distinct[:, 0], plan.n, 64)
    told = replies.filter(pa.array(kind == 2))
    repeats = np.zeros(len(distinct), bool)
    for b, raw in zip(K.cells(told, "bucket"), K.cells(told, "body")):
        repeats[at[b] : at[b + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=int(at[b + 1] - at[b]))
    starts = places[repeats[inverse]] if len(distinct) else places
    edges = np.zeros(int(bounds[-1]) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + plan.window, -1)
    gone = np.cumsum(edges)[:-1] > 0
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[bounds[1:]] - total[bounds[:-1]]
    kept = []
    data, offsets = T.buffers(large_texts(table))
    for i, n in enumerate(removed.tolist()):
        words = data[offsets[i] : offsets[i + 1]].tobytes().split()
        if n:
            stay = ~gone[bounds[i] : bounds[i + 1]]
            words = [w for w, s in zip(words, stay.tolist()) if s]
        kept.append(b" ".join(words).decode())
    done = pa.table([table.column("id"), pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema=schema)
    return done if len(row_of) == done.num_rows else done.take(pa.array(row_of))


def dedup(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_chars: int | None = None) -> DataFrame:
    """(id, n_words, n_removed, kept): every row's text without repeated windows, words joined by one space."""
    dealt = K.layout(df, text_col, block_chars)
    plan = Plan(window, dealt.n, min(48, max(16, dealt.chars.bit_length() + 1)))
    docs = K.blocked(df, dealt, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    arrow_id = docs.limit(0).select("id").toArrow().schema.field(0).type
    schema = pa.schema([("id", arrow_id), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
    cells = K.answer(K.ask(docs, lambda t: _sketch(plan, t), _MESSAGE), dealt, lambda t: _merge(plan, t), _REPLY)
    keys = K.answer(K.tell(docs, cells, lambda t, r: _candidates(plan, t, r), _MESSAGE), dealt, lambda t: _group(plan, t), _REPLY)
    out = K.tell(docs, cells.unionAll(keys), lambda t, r: _remove(plan, schema, t, r), f"id {kind}, n_words bigint, n_removed bigint, kept string")
    return out.withColumnRenamed("id", id_col)


def report(deduped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return deduped.select(F.col(id_col), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
