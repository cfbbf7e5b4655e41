"""Operator 2: language-model scoring with a weighted backoff automaton.

Tokens are words (A-Z lower-cased, ``[^\\x20\\x09-\\x0D]+``) and one end per document; a start precedes the
first token. Training documents give exact counts c of all n-grams up to ``ORDER`` tokens. The smoothed
n-grams form an automaton. Its states are the empty history (root) and every history of up to
``ORDER`` - 1 tokens seen in training. A state h has

* an arc for every token w seen after it, weighing (c(h w) + m * P(w | h')) / (c(h) + m), which leads to
  the longest suffix of h w that is a state;
* a failure arc to h' (h without its oldest token), weighing m / (c(h) + m);

with m = ``PRIORS[len(h)]``. The root has an arc of weight P(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)) for every
token. Each history's probabilities sum to 1. A text is read from left to right: from the state
carried along, failure arcs are followed until the state has an arc for the next token, and the log10
weights of all arcs taken add up. All texts of a block are read in step, long ones in ``STRETCH`` tokens, each
stretch starting ``ORDER`` - 1 tokens early at the root: after those, the state is that of the whole text.

The automaton of a whole corpus is larger than any one machine should hold, so each block of
documents builds the states and arcs its texts can take (see ``_blocks``): it asks for the counts of its
distinct tokens, then of its pairs, then of its triples. It does not ask for an n-gram one of whose two
parts (all tokens but the last, all but the first) occurs in no other block: then nobody else holds
the whole, and its own count is the total. Nothing is pruned or sampled, and the counts gathered grow
with the corpus.

Defined results: null text is the empty text (one token, the end); a null id is neither held out nor
learned from; rows equal in id and text count as often as they occur; without training rows N and V
are 0; an empty table gives an empty table; of a very long text a block holds some 150 bytes a
token at once. N-grams are told apart by 64-bit hashes: of n distinct ones, two share a hash with a
chance of about n**2 / 2**65, and then their counts add up.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm import _base as B
from panelcast.llm import _blocks as K
from panelcast.llm import _text as T

ORDER = 3
#: How many sightings the shorter history's estimate is worth, by the length of the history. Chosen on
#: training rows only, see README.
PRIORS = (0.0, 300.0, 3.0)
ADD = 0.1
STRETCH = 256
END, START = np.uint64(0x0E4D0E4D0E4D0E4D), np.uint64(0x57A257A257A257A2)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def ranked(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the values in order, the sorted values).

    Values whose lower bits give way to their places are sorted, several times as fast as places by values are. The
    upper bits decide but for a few collisions, which show in the result and are then sorted the slow way.
    """
    low = np.uint64((1 << len(hashes).bit_length()) - 1)
    packed = hashes & ~low
    packed |= np.arange(len(hashes), dtype=np.uint64)
    packed.sort()
    packed &= low
    order = packed.view(np.int64)
    ordered = hashes[order]
    if (ordered[1:] < ordered[:-1]).any():
        order = np.argsort(hashes)
        ordered = hashes[order]
    return order, ordered


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, a place of each, the number of each place's value)."""
    order, ordered = ranked(hashes)
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    of = np.empty(len(order), np.int32)
    number = np.cumsum(new, dtype=np.int32)
    number -= 1
    of[order] = number
    return ordered[new], order[new].astype(np.int32), of


class Grams:
    """The tokens of a block's texts and their n-grams up to ``order``.

    ``keys[n]`` are the distinct n-grams' hashes, sorted; ``of[n]`` is the n-gram that ends at each token
    (-1 where a text has too few before it); ``first[n]`` is a token where each n-gram ends.
    """

    def __init__(self, table: pa.Table, order: int) -> None:
        table, self.times, self.row_of = K.collapsed(table)
        texts = B.text_array(table, "text")
        data, offsets = T.buffers(texts)
        low = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(_FOLD[data]))
        words, bounds = T.word_hashes(low, T.SPACE)
        n = len(texts)
        self.bounds = bounds + np.arange(n + 1)  # each text has an end more
        tokens = np.insert(words, bounds[1:], END)
        train = np.asarray(table.column("train").combine_chunks().fill_null(False).to_numpy(zero_copy_only=False), bool)
        weight = np.repeat(np.where(train, self.times, 0), np.diff(self.bounds)).astype(np.float64)
        self.place = np.arange(len(tokens), dtype=np.int32)
        self.place -= np.repeat(self.bounds[:-1].astype(np.int32), np.diff(self.bounds))
        self.weight, self.order, self.mixed = weight, order, T.mix(tokens)
        self._prefix: dict[int, np.ndarray] = {}
        self._suffix: dict[int, np.ndarray] = {}
        self.keys, self.of, self.first, self.own = [None], [None], [None], [None]
        self.hashes = tokens
        for k in range(1, order + 1):
            if k > 1:
                self.hashes = self._longer(self.hashes, k)
            there = np.flatnonzero(self.place >= k - 2).astype(np.int32) if k > 2 else slice(None)
            keys, first, of = distinct(self.hashes[there])
            self.own.append(np.bincount(of, weights=weight[there], minlength=len(keys)).astype(np.int64))
            self.keys.append(keys)
            if k > 2:
                full = np.full(len(tokens), -1, np.int32)
                full[there] = of
                of, first = full, there[first]
            self.of.append(of)
            self.first.append(first)

    def _longer(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the k-grams: that of the k - 1 tokens one place before, and the last token's."""
        before = np.empty_like(hashes)
        before[1:] = hashes[:-1]
        before[self.place == 0] = START if k == 2 else 0
        with np.errstate(over="ignore"):
            before *= np.uint64(0x9E3779B97F4A7C15)
            before += self.mixed
            return T.mix(before)

    def longer_asked(self, shared: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Keys and own counts of the n-grams of ``order`` + 1 tokens that ``asked`` names, and of no others."""
        n = self.order + 1
        some = np.append(shared[n - 1], False)[self.of[n - 1]]
        fine = some & (self.place >= n - 2)
        if n > 2:
            fine[1:] &= some[:-1]
        else:
            fine[1:] &= some[:-1] | (self.place[1:] == 0)
        where = np.flatnonzero(fine)
        keys, _, of = distinct(self._longer(self.hashes, n)[where])
        return keys, np.bincount(of, weights=self.weight[where], minlength=len(keys)).astype(np.int64)

    def prefix(self, n: int) -> np.ndarray:
        """For each n-gram, the (n - 1)-gram of its first tokens; -1 for the start alone."""
        if n not in self._prefix:
            at = self.first[n]
            self._prefix[n] = np.where(self.place[at] > 0, self.of[n - 1][at - 1], np.int32(-1))
        return self._prefix[n]

    def suffix(self, n: int) -> np.ndarray:
        """For each n-gram, the (n - 1)-gram of its last tokens."""
        if n not in self._suffix:
            self._suffix[n] = self.of[n - 1][self.first[n]]
        return self._suffix[n]

    def asked(self, n: int, shared: list[np.ndarray]) -> np.ndarray:
        """The n-grams whose parts other blocks hold too, so that they may hold the whole."""
        if n == 1:
            return np.arange(len(self.keys[1]))
        some = np.append(shared[n - 1], True)  # the start is everybody's
        return np.flatnonzero(some[self.prefix(n)] & some[self.suffix(n)])

    def told(self, replies: pa.Table | None, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Total counts of all n-grams up to ``most`` tokens, and whether other blocks hold them too."""
        counts, shared = [None], [None]
        level = np.array(K.cells(replies, "level")) if most else None
        for n in range(1, most + 1):
            mine = replies.filter(pa.array(level == n)).sort_by("bucket")
            raw = np.concatenate([np.zeros(0, np.uint64), *(K.integers(x) for x in K.cells(mine, "counts"))]).astype(np.int64)
            asked = self.asked(n, shared)
            counts.append(self.own[n].copy())
            shared.append(np.zeros(len(self.keys[n]), bool))
            counts[n][asked], shared[n][asked] = raw >> 1, raw & 1
        return counts, shared


class Automaton:
    """The part of the backoff automaton that some texts can reach.

    States are numbered by the length of their history: 0 is the root, 1 the start, which counts as a token,
    ``least[n]`` the first state of n tokens. The arcs of states of n - 1 tokens are numbered as the n-grams are:
    ``arcs[n]`` tells which there are, ``arc_log[n]`` their weights, ``arc_next[n]`` where they lead.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], total: int, distinct: int, priors: tuple[float, ...]) -> None:
        g, order = grams, grams.order
        self.grams = g
        self.root = (counts[1] + ADD) / (total + ADD * (distinct + 1))  # the root's arcs
        end = np.searchsorted(g.keys[1], END)
        starts = float(counts[1][end]) if end < len(g.keys[1]) and g.keys[1][end] == END else 0.0
        state, seen, fail, prior = [None], [np.array([0.0, starts])], [np.zeros(2, np.int32)], [np.zeros(1), np.array([priors[1] if order > 1 else 0.0])]
        size, self.least = 2, [0, 1]
        for n in range(1, order):
            known = counts[n] > 0
            if n == 1:
                known[end : end + 1] &= g.keys[1][end : end + 1] != END  # nothing follows an end
            else:
                known &= (g.suffix(n) if n == 2 else g.of[1][g.first[n]]) != end
            known = np.flatnonzero(known)
            number = np.full(len(g.keys[n]) + 1, -1, np.int32)
            number[known] = np.arange(size, size + len(known), dtype=np.int32)
            state.append(number)
            seen.append(counts[n][known].astype(np.float64))
            fail.append(np.zeros(len(known), np.int32) if n == 1 else state[n - 1][g.suffix(n)[known]])
            prior.append(np.full(len(known), priors[n]))
            if n > 1:
                self.least.append(size)
            size += len(known)
        self.seen, self.fail, prior = np.concatenate(seen), np.concatenate(fail), np.concatenate(prior)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.fail_log = np.where(self.seen + prior > 0, np.log10(prior / (self.seen + prior)), 0.0)
        self.token_state = np.maximum(state[1][:-1], 0) if order > 1 else np.zeros(len(self.root), np.int32)
        self.root_log = np.log10(self.root)
        weight = self.root
        self.src, self.arcs, self.arc_log, self.arc_next = ([None, None] for _ in range(4))
        for n in range(2, order + 1):
            pre, suf, there = g.prefix(n), g.suffix(n), counts[n] > 0
            src = state[n - 1][pre]  # for n-grams without an arc, any state
            if n == 2:
                src[pre < 0] = 1
            m = prior[src]
            with np.errstate(divide="ignore", invalid="ignore"):
                mine = weight[suf]
                mine *= m
                mine += counts[n]
                m += self.seen[src]
                mine /= m
                self.arc_log.append(np.log10(mine))
            mine[~there] = 0.0
            to = state[n][:-1] if n < order else state[n - 1][suf]
            self.src.append(src)
            self.arcs.append(there)
            self.arc_next.append(np.maximum(to, 0))  # after an end nothing is read
            weight = mine

    @functools.cached_property
    def _by_state(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length, the arcs there are by state and token, and the keys they are in order of."""
        out: list = [None, None]
        for n in range(2, self.grams.order + 1):
            there = np.flatnonzero(self.arcs[n])
            keys = self.src[n][there] * np.int64(len(self.root)) + self.grams.of[1][self.grams.first[n][there]]
            order = np.argsort(keys)
            out.append((there[order], keys[order]))
        return out

    def arc_of(self, n: int, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The arcs from states of n - 1 tokens for tokens that need not follow in any text; -1 where there is none."""
        arcs, keys = self._by_state[n]
        key = state * np.int64(len(self.root)) + token
        at = np.searchsorted(keys, key)
        return np.where(np.append(keys, -1)[at] == key, np.append(arcs, -1)[at], -1)

    def step(self, state: np.ndarray, token: np.ndarray, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(log10 weight, next state) of reading ``token`` in ``state``, failure arcs followed as needed.

        Where ``place`` tells where in the texts the tokens stand, and the states are those of what precedes them there,
        an arc needs no search: its number is that of the n-gram that ends there.
        """
        log, to, at = np.zeros(len(state)), np.zeros(len(state), np.int32), state.copy()
        for n in range(self.grams.order, 1, -1):
            here = np.flatnonzero(at >= self.least[n - 1])  # states of n - 1 tokens: the longer ones have failed or are done
            arc = self.arc_of(n, at[here], token[here]) if place is None else self.grams.of[n][place[here]]
            found = self.arcs[n][arc] & (arc >= 0)
            done, arc = here[found], arc[found]
            log[done] += self.arc_log[n][arc]
            to[done] = self.arc_next[n][arc]
            at[done] = -1
            left = here[~found]
            log[left] += self.fail_log[at[left]]
            at[left] = self.fail[at[left]]
        root = np.flatnonzero(at == 0)
        log[root] += self.root_log[token[root]]
        to[root] = self.token_state[token[root]]
        return log, to

    def walk(self, grams: Grams) -> np.ndarray:
        """Log10 probability of each text, read from left to right with the state carried along."""
        tokens, early = grams.of[1], grams.order - 1
        sizes = np.diff(grams.bounds)
        parts = -(-sizes // STRETCH)
        text = np.repeat(np.arange(len(sizes)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = nth * STRETCH
        stop = np.minimum(begin + STRETCH, sizes[text])
        at = np.where(nth > 0, np.maximum(begin - early, 0), 0)
        state = np.where((at > 0) | (early == 0), 0, 1).astype(np.int32)  # the start's state, or the root for a stretch that starts early
        order = np.argsort(-(stop - at), kind="stable")  # those still being read come first
        at, begin, stop, state, text = at[order], begin[order] + grams.bounds[text[order]], stop[order], state[order], text[order]
        length, base = stop - at, grams.bounds[text]
        out = np.zeros(len(text))
        for t in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -t, "left"))  # lengths above t
            place = base[:n] + at[:n] + t
            log, state[:n] = self.step(state[:n], tokens[place], place)
            out[:n] += np.where(place >= begin[:n], log, 0.0)
        return np.bincount(text, weights=out, minlength=len(sizes))


_MESSAGE = "bucket bigint, block bigint, body binary"
_REPLY = "block bigint, bucket bigint, level int, counts binary, total bigint, distinct bigint"


def _ask(level: int, buckets: int, table: pa.Table, replies: pa.Table | None = None) -> pa.Table:
    """A block's question about n-grams of ``level`` tokens: keys and own counts by bucket."""
    out: dict[str, list] = {"bucket": [], "block": [], "body": []}
    if table.num_rows:
        g, block = Grams(table, max(1, level - 1)), table.column("block")[0].as_py()
        keys, own = (g.keys[1], g.own[1]) if level == 1 else g.longer_asked(g.told(replies, level - 1)[1])
        at = K.cuts(keys, buckets, 64)
        for b in np.flatnonzero(np.diff(at)).tolist():
            part = slice(at[b], at[b + 1])
            for name, value in (("bucket", b), ("block", block), ("body", K.counted_keys(keys[part], own[part]))):
                out[name].append(value)
    return pa.table({k: pa.array(v, pa.binary() if k == "body" else pa.int64()) for k, v in out.items()})


def _answer(level: int, table: pa.Table) -> pa.Table:
    """For each message the sums over all blocks, doubled, and one more where several blocks asked;
    and the bucket's tokens and distinct ones."""
    sent = [K.keys_counted(x) for x in K.cells(table, "body")]
    own = [k for k, _ in sent]
    keys, _, of = distinct(np.concatenate(own))
    times = np.bincount(of, minlength=len(keys))
    sums = np.bincount(of, weights=np.concatenate([c for _, c in sent]).astype(np.float64), minlength=len(keys)).astype(np.int64)
    coded = 2 * sums + (times > 1)  # a block asks for a key once
    ends, n = np.cumsum([len(k) for k in own]), len(own)
    return pa.table(
        {
            "block": table.column("block"),
            "bucket": table.column("bucket"),
            "level": pa.array([level] * n, pa.int32()),
            "counts": pa.array([K.varints(coded[of[e - len(k) : e]]) for e, k in zip(ends.tolist(), own)], pa.binary()),
            "total": pa.array([int(sums.sum())] * n, pa.int64()),
            "distinct": pa.array([int((sums > 0).sum())] * n, pa.int64()),
        }
    )


def _at(level: int, buckets: int) -> tuple[Callable[[pa.Table, pa.Table], pa.Table], Callable[[pa.Table], pa.Table]]:
    """Question and answer of one level."""
    return lambda t, r: _ask(level, buckets, t, r), lambda t: _answer(level, t)


def _score(order: int, priors: tuple[float, ...], schema: pa.Schema, table: pa.Table, replies: pa.Table) -> pa.Table:
    if not table.num_rows:
        return schema.empty_table()
    g = Grams(table, order)
    counts, _ = g.told(replies, order)
    total, distinct = (K.cells(replies, c)[0] for c in ("total", "distinct"))
    auto = Automaton(g, counts, total, distinct, priors)
    add = lambda x: np.add.reduceat(x[g.of[1]], g.bounds[:-1])
    found = [np.diff(g.bounds), add((counts[1] > 0).astype(np.int64)), np.full(len(g.bounds) - 1, total), add(auto.root_log), auto.walk(g)]
    return pa.table([table.column("id"), table.column("held_out"), *(pa.array(x[g.row_of]) for x in found)], schema=schema)


def score(
    df: DataFrame, held_out: Column, order: int = ORDER, priors: tuple[float, ...] = PRIORS, id_col: str = "doc_id", text_col: str = "text", block_chars: int | None = None
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from the rows where ``held_out`` is false; where it is null, the row is
    neither learned from nor held out. ``priors[k]`` belongs to histories of k tokens.
    """
    plan = K.layout(df, text_col, block_chars)
    docs = K.blocked(df, plan, id_col, text_col, held_out=F.coalesce(held_out, F.lit(False)), train=F.coalesce(~held_out, F.lit(False)))
    kind = df.schema[id_col].dataType.simpleString()
    arrow_id = docs.limit(0).select("id").toArrow().schema.field(0).type
    names = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    schema = pa.schema([("id", arrow_id), ("held_out", pa.bool_()), *names])
    first = K.answer(K.ask(docs, lambda t: _ask(1, plan.n, t), _MESSAGE), plan, lambda t: _answer(1, t), _REPLY)
    # each bucket's part of the totals once, then one sum for all
    once = first.groupBy("bucket").agg(F.max("total").alias("total"), F.max("distinct").alias("distinct"))
    whole = [once.agg(F.sum(c)).scalar().alias(c) for c in ("total", "distinct")]
    replies = first.select("block", "bucket", "level", "counts")
    for level in range(2, order + 1):
        question, reply = _at(level, plan.n)
        told = K.answer(K.tell(docs, replies, question, _MESSAGE), plan, reply, _REPLY)
        replies = replies.unionAll(told.select("block", "bucket", "level", "counts"))
    replies = replies.select("*", *whole)
    fields = "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    out = K.tell(docs, replies, lambda t, r: _score(order, priors, schema, t, r), f"id {kind}, {fields}")
    return out.withColumnRenamed("id", id_col)
