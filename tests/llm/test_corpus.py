"""Operators 2, 3, 7, 8, 9 and the pipeline against brute force on small fixtures."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelcast.llm import _base as B
from panelcast.llm import _blocks as K
from panelcast.llm import decontaminate, near_dup, ngram_lm, substring_dedup, topk
from panelcast.llm.components import connected_components

SPACE = r"[^\x20\x09-\x0D]+"


def corpus(seed, n=60, vocab=40, longest=120):
    """Texts with exact and near copies and shared passages."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["", "é", "X"]) + f"w{rng.randrange(vocab)}"
    passage = " ".join(word() for _ in range(50))
    texts = []
    for i in range(n):
        t = [word() for _ in range(rng.randrange(longest))]
        if i % 5 == 1 and texts:
            t = (texts[rng.randrange(len(texts))] or "").split()
            for _ in range(rng.randrange(4)):
                if t:
                    t[rng.randrange(len(t))] = word()
        elif i % 7 == 2:
            t = t + passage.split() + [word()]
        texts.append(rng.choice([" ", "\n", "\t "]).join(t))
    return [*texts, None, "", "one", "one", "two words", texts[0], texts[1], passage + " " + passage]


def rows_by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=str)


# --- 2 -----------------------------------------------------------------------------------------


def brute_scores(texts, train, order, priors):
    """(n_tokens, n_known, train_tokens, base_score, score) by the recursive definition."""
    tokens = [[*re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for t in texts]
    counts = Counter(tuple(p[i : i + n]) for t, y in zip(tokens, train) if y for p in [["<s>", *t]] for n in range(1, order + 1) for i in range(len(p) - n + 1))
    n_all, distinct = sum(c for g, c in counts.items() if len(g) == 1 and g != ("<s>",)), sum(len(g) == 1 and g != ("<s>",) for g in counts)

    def p(history, w):
        if not history:
            return (counts[(w,)] + 0.1) / (n_all + 0.1 * (distinct + 1))
        m = priors[len(history)]
        return (counts[(*history, w)] + m * p(history[1:], w)) / (counts[history] + m)

    out = []
    for t in tokens:
        padded = ["<s>", *t]
        score = sum(math.log10(p(tuple(padded[max(0, i - order + 1) : i]), padded[i])) for i in range(1, len(padded)))
        out.append((len(t), sum(counts[(w,)] > 0 for w in t), n_all, sum(math.log10(p((), w)) for w in t), score))
    return out


@pytest.mark.parametrize("order, chars", [(1, 3000), (2, 3000), (3, 10**9), (3, 3000), (4, 3000)])
def test_scores_by_brute_force(docs, monkeypatch, order, chars):
    monkeypatch.setattr(ngram_lm, "STRETCH", 16)  # texts are read in several stretches
    texts = [*corpus(1), " ".join(f"w{i % 40}" for i in range(3000))]  # one is long
    priors = (0.0, 20.0, 3.0, 1.5)
    frame = docs([*enumerate(texts), (None, "null id"), (7, texts[7]), (7, texts[7]), (8, texts[8])])
    held = F.col("doc_id") % 4 == 0
    got = {r.doc_id: r for r in ngram_lm.score(frame, held, order=order, priors=priors, block_chars=chars).collect()}
    many = [*texts, "null id", texts[7], texts[7], texts[8]]
    want = brute_scores(many, [*(i % 4 > 0 for i in range(len(texts))), False, True, True, False], order, priors)
    for i, w in zip([*range(len(texts)), None], want):
        r = got[i]
        assert r.held_out == (i is not None and i % 4 == 0) and (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert r.base_score == pytest.approx(w[3]) and r.score == pytest.approx(w[4])


def test_longer_histories_score_held_out_texts_better(docs):
    rng = random.Random(21)
    lines = [" ".join(f"w{rng.randrange(300)}" for _ in range(8)) for _ in range(60)]  # lines recur, pairs do not tell them
    frame = docs([" ".join(rng.choice(lines) for _ in range(12)) for _ in range(200)])
    score = lambda n: ngram_lm.score(frame, F.col("doc_id") % 10 == 0, order=n).filter("held_out").agg(F.sum("score")).first()[0]
    assert score(1) < score(2) < score(3)


def test_states_of_any_reading_are_the_same():
    """Reading a text in stretches that start early at the root carries the state of the whole text."""
    texts = [t or "" for t in corpus(13)]
    table = pa.table({"block": [0] * len(texts), "id": range(len(texts)), "text": texts, "train": [i % 3 > 0 for i in range(len(texts))]})
    grams = ngram_lm.Grams(table, 3)
    auto = ngram_lm.Automaton(grams, grams.own, int(grams.own[1].sum()), int((grams.own[1] > 0).sum()), (0.0, 20.0, 3.0))
    tokens = grams.of[1]
    for a, b, whole in zip(grams.bounds[:-1].tolist(), grams.bounds[1:].tolist(), auto.walk(grams)):
        state, total = np.array([1], np.int32), 0.0
        for w in tokens[a:b]:
            log, state = auto.step(state, np.array([w]))
            total += log[0]
        assert total == pytest.approx(whole)
    assert (auto.fail[1:] < np.arange(1, len(auto.fail))).all()  # failure arcs lead to shorter histories


def test_arcs_of_texts_need_no_search(monkeypatch):
    """Reading a text finds the arcs by its n-grams' numbers: the same ones as a search by state and token."""
    texts = [t or "" for t in corpus(14)]
    table = pa.table({"block": [0] * len(texts), "id": range(len(texts)), "text": texts, "train": [i % 3 > 0 for i in range(len(texts))]})
    grams = ngram_lm.Grams(table, 3)
    auto = ngram_lm.Automaton(grams, grams.own, int(grams.own[1].sum()), int((grams.own[1] > 0).sum()), (0.0, 20.0, 3.0))
    state = np.ones(len(texts), np.int32)
    for t in range(int(np.diff(grams.bounds).max())):
        on = np.flatnonzero(np.diff(grams.bounds) > t)
        place = grams.bounds[on] + t
        searched, known = auto.step(state[on], grams.of[1][place]), auto.step(state[on], grams.of[1][place], place)
        assert (searched[0] == known[0]).all() and (searched[1] == known[1]).all()
        state[on] = known[1]
    monkeypatch.setattr(ngram_lm.Automaton, "arc_of", None)
    assert np.isfinite(auto.walk(grams)).all()


def test_ranks_of_values_that_share_upper_bits():
    rng = np.random.default_rng(15)
    for top in (1, 5, 2**20):
        for n in (0, 1, 2, 1000):
            values = (rng.integers(0, top, n, dtype=np.uint64) << np.uint64(44)) | rng.integers(0, 7, n, dtype=np.uint64)
            order, ordered = ngram_lm.ranked(values)
            assert (ordered == np.sort(values)).all() and (values[order] == ordered).all() and (np.sort(order) == np.arange(n)).all()
            keys, first, of = ngram_lm.distinct(values)
            assert (keys == np.unique(values)).all() and (keys[of] == values).all() and (values[first] == keys).all()


def test_hot_rows_do_not_fill_a_block(spark, docs):
    """Rows equal in id and text are dealt by input partition and collapsed in their block."""
    frame = docs([(7, "a b c d")] * 4000 + [(i, f"x{i} y{i} z{i} u{i}") for i in range(8, 8008)]).repartition(8)
    plan = K.layout(frame, "text", 20_000)
    sizes = [r["count"] for r in K.blocked(frame, plan, "doc_id", "text").groupBy("block").count().collect()]
    assert plan.n > 8 and max(sizes) < 4000
    rows = ngram_lm.score(frame, F.lit(False), block_chars=20_000)
    assert rows.count() == 12_000 and rows.filter("doc_id = 7").select("score").distinct().count() == 1
    table = pa.table({"block": [0] * 5, "id": [1, 1, None, 1, 2], "text": ["a", "b", None, "a", "a"]})
    distinct, times, of = K.collapsed(table)
    assert distinct.select(["id", "text"]).to_pylist() == [{"id": 1, "text": "a"}, {"id": 1, "text": "b"}, {"id": None, "text": None}, {"id": 2, "text": "a"}]
    assert times.tolist() == [2, 1, 1, 1] and of.tolist() == [0, 1, 2, 0, 3]


def test_blocks_grow_with_the_corpus():
    assert K.block_chars(10**9) == K.block_chars(10**12) == 8_000_000
    assert K.block_chars(4 * 10**12) == 16_000_000 and K.block_chars(10**16) == 64_000_000


def test_probabilities_sum_to_one(docs):
    frame = docs(["a b a", "b a", "c"])
    root = {w: n for w, n in zip("abc", (3, 2, 1))}
    total, distinct = 6 + 3, 4
    p1 = {w: (n + 0.1) / (total + 0.1 * (distinct + 1)) for w, n in root.items()} | {"end": 3.1 / (total + 0.5), "other": 0.1 / (total + 0.5)}
    assert sum(p1.values()) == pytest.approx(1)
    scores = {r.doc_id: r for r in ngram_lm.score(frame, F.lit(False)).collect()}
    assert scores[2].train_tokens == total
    assert scores[2].base_score == pytest.approx(math.log10(p1["c"]) + math.log10(p1["end"]))


def test_scores_without_training(docs):
    r = ngram_lm.score(docs(["a"]), F.lit(True)).first()
    assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, pytest.approx(0.0)) and r.score == pytest.approx(0.0)
    assert ngram_lm.score(docs(["a"]).filter("false"), F.lit(True)).count() == 0


# --- 3 -----------------------------------------------------------------------------------------


def brute_topk(rows, k, scale):
    q = [(i, [int(x) for x in np.floor(scale * np.array(v, float))]) for i, v in rows]
    out = []
    for a, (i, v) in enumerate(q):
        if i % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(q) if a != b and len(v) == len(w))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("spread", [1.0, 0.01, 1e5])
def test_topk_by_brute_force(spark, docs, spread, monkeypatch):
    for name, value in (("BLOCK", 3), ("ROWS", 50), ("SLOTS", 2)):
        monkeypatch.setattr(topk, name, value)  # many blocks
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * spread).tolist()) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(60)]  # many equal scores
    rows += [(0, [1.0] * 6), (0, [9.0] * 6), (50, rows[50][1]), (50, rows[50][1]), (7, rows[7][1])]  # repeated ids and rows
    rows += [(1100, [1.0, 2.0]), (1101, [2.0, 2.0]), (1150, [3.0])]  # other lengths
    bad = [(900, None), (950, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1000, [float("nan")] * 6), (1001, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([*rows, *bad], "vec_id bigint, embedding array<double>").selectExpr("*", "1 as score", "2 as id", "3 as dim").repartition(5)
    got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == brute_topk(rows, 5, 256)


def test_topk_agrees_with_its_sql_on_repeated_ids(spark, docs, tmp_path):
    import duckdb

    from panelcast.llm.queries import ORACLES, op3_topk_histogram

    rows = [(0, [0.1, 0.5]), (0, [0.9, 0.2]), (0, [0.9, 0.2]), (1, [0.2, 0.3]), (2, [0.3, 0.1]), (50, [0.4, 0.4]), (50, None)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, op3_topk_histogram(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.execute(ORACLES["op3_topk_histogram"]).fetchall()) == brute_topk([(i, np.array(v, np.float32).tolist()) for i, v in rows if v], 5, 256)
    assert len(got) == 20  # each of the three rows of id 0 and the one of id 50 is answered


def test_topk_with_few_or_no_candidates(spark, docs):
    schema = "vec_id bigint, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0]), (1, [-2.0]), (2, [3.0])], schema)
    assert sorted(map(tuple, topk.search(few, F.col("vec_id") == 0, scale=1).collect())) == [(0, 1, 2, 3), (0, 2, 1, -2)]
    assert topk.search(few.filter("false"), F.lit(True)).count() == 0
    assert topk.search(few.filter("vec_id = 0"), F.lit(True)).count() == 0
    assert topk.search(few, F.lit(False)).count() == 0
    assert topk.search(few.selectExpr("vec_id", "array() as embedding").withColumn("embedding", F.col("embedding").cast("array<float>")), F.col("vec_id") == 0, k=1).count() == 1


# --- 7 -----------------------------------------------------------------------------------------


def brute_dedup(texts, k):
    words = [re.findall(SPACE, t or "") for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("chars, k", [(10**9, 35), (500, 35), (200, 3)])
def test_dedup_by_brute_force(docs, chars, k):
    texts = corpus(2)
    got = rows_by_id(substring_dedup.dedup(docs(texts), k, block_chars=chars), "n_words", "n_removed", "kept")
    assert got == sorted(((i, *r) for i, r in enumerate(brute_dedup(texts, k))), key=str)
    assert sum(r[2] for r in got) > 0


def test_dedup_edge_cases(docs):
    same = " ".join(f"w{i}" for i in range(40))
    got = rows_by_id(substring_dedup.dedup(docs([(1, same), (1, same), (None, None)])), "n_removed", "kept")
    assert got == [(1, 40, ""), (1, 40, ""), (None, 0, "")]
    many = docs([(1, same)] * 50 + [(2, same + " z"), (3, "y " + " ".join(f"v{i}" for i in range(60)))])
    got = rows_by_id(substring_dedup.dedup(many, block_chars=500), "n_removed", "kept")
    assert got == [(1, 40, "")] * 50 + [(2, 40, "z"), (3, 0, "y " + " ".join(f"v{i}" for i in range(60)))]
    long = " ".join(f"l{i}" for i in range(200_000))
    got = rows_by_id(substring_dedup.dedup(docs([long, f"a {long} b"]), block_chars=500_000), "n_removed", "kept")
    assert got == [(0, 200_000, ""), (1, 200_000, "a b")]
    assert substring_dedup.dedup(docs(["x"]).filter("false")).count() == 0
    row = substring_dedup.report(substring_dedup.dedup(docs(["a  b"]))).first()
    assert row.kept_sha256 == hashlib.sha256(b"a b").hexdigest()


# --- 8 -----------------------------------------------------------------------------------------


def brute_join(texts, words=5, threshold=0.8):
    sets = []
    for t in texts:
        w = re.findall(SPACE, t or "")
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    n, t = len(sets), Fraction(str(threshold))
    linked = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in linked[i])]) for i in range(n)]
    return [(i, root[i], len(linked[i]), sum(bool(s) and s == sets[i] for s in sets) or 1) for i in range(n)]


@pytest.mark.parametrize("side, block, least, sent", [(512, 1024, 160, 10**6), (4, 4, 2, -1), (1, 1024, 5, 10**6)])
def test_join_by_brute_force(docs, monkeypatch, side, block, least, sent):
    for name, value in (("SIDE", side), ("BLOCK", block), ("LEAST", least), ("PART_ROWS", 50 * block), ("BROADCAST_ROWS", sent)):
        monkeypatch.setattr(near_dup, name, value)  # small: buckets join whole, groups split into pairs of blocks
    rng = random.Random(8)
    base = [f"v{rng.randrange(500)}" for _ in range(120)]
    family = []
    for _ in range(25):
        t = list(base)
        for _ in range(rng.randrange(1, 4)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        family.append(" ".join(t))
    texts = [*corpus(3), *family, *family[:3]]
    got = rows_by_id(near_dup.report(near_dup.join(docs(texts))), "class_id", "n_links", "n_copies")
    assert got == sorted(brute_join(texts), key=str)


def test_join_edge_cases(docs):
    frame = docs([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, None), (8, " \n"), (None, "")])
    got = rows_by_id(near_dup.report(near_dup.join(frame)), "class_id", "n_links", "n_copies")
    assert got == sorted([(5, 5, 2, 3), (5, 5, 2, 3), (None, 5, 2, 3), (7, 7, 0, 1), (8, 8, 0, 1), (None, None, 0, 1)], key=str)
    assert near_dup.join(frame.filter("false")).count() == 0
    kept = near_dup.one_of_each(frame)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect() if (r.text or "").strip()) == [(True, 0, "a b c d e f")]
    assert kept.count() == 4 and kept.columns == frame.columns


def test_repeated_rows_leave_one(docs):
    frame = docs([(5, "a b c d e f"), (5, "a b c d e f"), (9, "a b c d e f")])
    assert [r.doc_id for r in near_dup.one_of_each(frame).collect()] == [5]


def test_rows_that_differ_in_other_columns_leave_one(docs):
    frame = docs([(5, "a b c d e f"), (5, "a b c d e f"), (9, "a b c d e f")]).withColumn("source", F.monotonically_increasing_id().cast("string"))
    assert len({near_dup.one_of_each(frame.coalesce(n)).first().source for n in (1, 2)}) == 1


def test_very_long_texts_are_joined(docs):
    rng = random.Random(4)
    long = [f"y{rng.randrange(10**6)}" for _ in range(300_000)]
    near = [w if i % 100 else "z" for i, w in enumerate(long)]
    far = [w if i % 8 else "z" for i, w in enumerate(long)]
    got = rows_by_id(near_dup.report(near_dup.join(docs([" ".join(t) for t in (long, near, far)]))), "class_id", "n_links")
    assert got == [(0, 0, 1), (1, 0, 1), (2, 2, 0)]


def test_pruned_pairs_are_not_verified():
    """Pairs left by the pruning are all that is verified: their sets are met, the others' never."""
    rng = np.random.default_rng(6)
    sigs = rng.integers(0, 256, (300, 128), dtype=np.uint8)
    sigs[200:] = sigs[:100]
    want = {(i, i + 200) for i in range(100)}
    for side in (None, np.arange(300) // 200):
        got = [p for i, j in near_dup.unpruned(sigs, side, 0.8) for p in zip(i.tolist(), j.tolist())]
        assert len(got) == len(set(got)) and set(got) == want
    side = np.arange(300) % 2  # rows i and i + 200 are of one side
    assert not list(near_dup.unpruned(sigs, side, 0.8))


@pytest.mark.parametrize("n", [3, 60])
def test_common_shingles_of_pairs(n):
    rng = np.random.default_rng(n)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 120)).astype(np.uint64)) for _ in range(n)]
    flat, bounds = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    i, j = np.triu_indices(n, 1)
    for pick in (slice(None), slice(0, 2)):
        want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i[pick], j[pick])]
        assert near_dup.common_shingles(flat, bounds, i[pick], j[pick]).tolist() == want


def test_posterior_limits():
    least = near_dup.least_matches(0.8, 1e-6, 128)
    assert list(least) == sorted(least) and 0 < least[0] < 16 and least[-1] < 0.8 * 128
    rng = np.random.default_rng(5)
    sigs = rng.integers(0, 256, (2000, 128), dtype=np.uint8)
    near = sigs.copy()
    change = rng.random(near.shape) < 0.18
    near[change] = rng.integers(0, 256, change.sum(), dtype=np.uint8)
    both = np.concatenate([sigs, near])
    i = np.arange(2000)
    assert len(near_dup.survivors(both, i, i + 2000, 0.8)) == 2000
    assert len(near_dup.survivors(both, i, np.roll(i, 1), 0.8)) == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(5, 5), (3, 4), (None, 1)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    root = {x: x for e in edges for x in e if x is not None}
    for _ in root:
        for a, b in edges:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert {k: v for k, v in root.items() if k in got} == got
    assert all(k == v for k, v in root.items() if k not in got)


# --- 9 -----------------------------------------------------------------------------------------


def brute_leaks(texts, items, k=8):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {}
    for i, t in items:
        w = fold(t)
        n = min(k, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[a : a + n]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = fold(t), set(), set()
        for n in {len(g) for g in grams}:
            for a in range(len(w) - n + 1):
                if (g := grams.get(tuple(w[a : a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    found |= g
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


ITEMS = [(1, "The quick brown fox jumps over the lazy dog today"), (2, "short item"), (10, "quick brown fox jumps over the lazy dog"), (3, None), (4, "..."), (5, "Ünï cödé wörds äre wörds töö, yés thëy are")]


def test_leaks_by_brute_force(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string").selectExpr("*", "1 as hash", "2 as gram")
    texts = [None, "", "a short-ITEM here", "say: quick, brown fox jumps over the lazy dog!", "the quick brown fox jumps over the lazy", "ünï cödé wörds äre wörds töö, yés thëy", "the quick brown fox jumps over the lazy dog today and again quick brown fox jumps over the lazy dog", "short", "item"]
    frame = docs([*texts, (3, texts[3]), (None, "short item")])
    got = rows_by_id(decontaminate.report(frame, bench), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = [(i, *r) for (i, _), r in zip([*enumerate(texts), (3, 0), (None, 0)], brute_leaks([*texts, texts[3], "short item"], ITEMS))]
    assert got == sorted(want, key=str)


ALL_SIZES = [(100 + k, " ".join(f"t{k}x{j}" for j in range(k))) for k in range(1, 12)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark, monkeypatch):
    """Neither the operator nor Spark itself broadcasts anything."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in names}
    for k in names:
        spark.conf.set(k, "-1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def leak_texts():
    rng = random.Random(12)
    texts = [" ".join(rng.choice([*(t for _, t in ALL_SIZES), "filler", "quick brown fox jumps over the lazy dog", "t5x0 t5x1"]) for _ in range(rng.randrange(9))) for _ in range(40)]
    return [*texts, None, "", "quick brown fox jumps over the lazy dog", "word " * 50_000 + "short item " + "w " * 50_000]


def check_leaks(spark, docs):
    items, texts = [*ITEMS, *ALL_SIZES], leak_texts()
    frame = decontaminate.report(docs(texts), spark.createDataFrame(items, "item_id bigint, text string"))
    got = rows_by_id(frame, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(((i, *r) for i, r in enumerate(brute_leaks(texts, items))), key=str)
    assert sum(r[2] > 0 for r in got) > 20
    return plan_of(frame)


def test_leaks_of_every_item_size(spark, docs):
    assert "BroadcastHashJoin" in check_leaks(spark, docs)


def test_leaks_without_broadcast(spark, docs, no_broadcast):
    plan = check_leaks(spark, docs)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_leaks_read_the_documents_once(spark, docs, data_dir, no_broadcast, tmp_path):
    docs(leak_texts()).select("doc_id", "text").write.parquet(f"{tmp_path}/d")
    frame = decontaminate.report(spark.read.parquet(f"{tmp_path}/d"), spark.createDataFrame([*ITEMS, *ALL_SIZES], "item_id bigint, text string"))
    assert plan_of(frame).split("== Initial Plan ==")[0].count("FileScan parquet") == 1


def test_leaks_shuffle_in_proportion_to_the_words(spark, docs, no_broadcast):
    """A document twice as long sends about twice as much through the join."""
    def sent(n):
        frame = decontaminate.report(docs([" ".join(f"u{i}" for i in range(n))]), spark.createDataFrame(ITEMS, "item_id bigint, text string"))
        frame.collect()
        total, todo = 0, [frame._jdf.queryExecution().executedPlan()]
        while todo:
            p = todo.pop()
            name = p.nodeName()
            if name == "AdaptiveSparkPlan":
                todo.append(p.executedPlan())
                continue
            if name.endswith("QueryStage"):
                todo.append(p.plan())
                continue
            if name == "Exchange":
                total = max(total, p.metrics().apply("dataSize").value())
            kids = p.children()
            todo += [kids.apply(i) for i in range(kids.size())]
        return total

    small, large = sent(2000), sent(8000)
    assert 3 < large / small < 5


def test_cleaning(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    frame = docs(["  Keep, this! a short  item, and (this).", "quick brown fox jumps over the lazy dog", "untouched  text.", None])
    out = decontaminate.clean(frame, bench)
    assert {r.doc_id: r.text for r in out.collect()} == {0: "  Keep, this! a and (this).", 2: "untouched  text.", 3: None}
    assert out.columns == frame.columns
    none = decontaminate.report(frame, bench.filter("false"))
    assert {(r.n_hit, r.contaminated) for r in none.collect()} == {(0, False)} and none.count() == 4
    assert decontaminate.report(frame.filter("false"), bench).count() == 0


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline_by_brute_force(spark, data_dir):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    seen, frame = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, data_dir)
        seen[name] = {r.doc_id: r for r in frame.collect()}
        if name != "encoded":
            assert frame.columns == docs.columns
    start = {r.doc_id: r.text for r in docs.collect()}
    assert set(seen["language"]) == {i for i, t in start.items() if any(c.isalpha() for c in t or "")}
    ids = sorted(seen["language"])
    kept = {ids[r[1]] for r in brute_join([start[i] for i in ids])}
    assert set(seen["near_duplicates"]) == kept
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    order = sorted(kept)
    leaks = dict(zip(order, brute_leaks([start[i] for i in order], items)))
    assert set(seen["decontaminated"]) == {i for i in order if not leaks[i][4]}
    for i, r in seen["decontaminated"].items():
        assert (r.text == start[i]) == (leaks[i][1] == 0)
        assert brute_leaks([r.text], items)[0][1] == 0
    assert set(seen["without_secrets"]) == set(seen["decontaminated"])
    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, r in seen["encoded"].items():
        assert r.n_tokens == len(tool.encode(seen["without_secrets"][i].text, add_special_tokens=False).ids)
    assert corpus_pipeline.run(spark, data_dir).count() == len(seen["encoded"])


def small_tables(spark, place, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in rows], schema).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place)


def test_pipeline_of_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    a, b = "the house stands near the river and the old road " * 5, "das haus steht am fluss und die alte strasse " * 5
    rows = [(i, f"{a} number{i} {' '.join(f'w{i}x{j}' for j in range(30))}", "en") for i in range(8)]
    rows += [(10 + i, f"{b} zahl{i} {' '.join(f'v{i}y{j}' for j in range(30))}", "de") for i in range(8)]
    rows += [(None, a + "no id", "en"), (None, a + "no id", "en"), (30, a + "twice", None), (30, a + "twice", None), (31, None, "en"), (32, "", "de"), (33, "123 $$$", "en")]
    rows += [(34, "東京 " * 30, None), (35, a + "the quick brown fox jumps over the lazy dog today, a short item", "en"), (36, a + "password = hunter2345", "en")]
    rows += [(37, " ".join(f"{'the' if j % 2 else 'house'} river{j}" for j in range(40_000)), "en")]
    place = small_tables(spark, tmp_path / "t", rows)
    out = corpus_pipeline.run(spark, place).collect()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in out)
    assert len(ids) == len(set(ids))  # copies are gone, repeated rows and null ids included
    kept = {r.doc_id for r in out}
    assert {31, 32, 33, 34, 35}.isdisjoint(kept) and {0, 10, 36, 37} <= kept
    empty = small_tables(spark, tmp_path / "e", [])
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_language_stage_uses_the_prediction(spark, data_dir):
    """The stage drops what the predicted language hardly knows, and nothing else of its input."""
    import corpus_pipeline
    from panelcast.llm import language_id

    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    strange = docs.limit(3).withColumn("doc_id", -F.col("doc_id") - 1).withColumn("lang", F.lit(None).cast("string")).withColumn("text", F.lit("Жук щит яма " * 20))
    out = corpus_pipeline.language(spark, docs.unionAll(strange), data_dir)
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    assert min(kept) >= 0 and out.columns == docs.columns
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    judged = language_id.predict(docs, language_id.fit(docs, remainder != 2), ["doc_id"]).collect()
    assert kept == {r.doc_id for r in judged if r.lang_pred != "und" and r.known >= language_id.KNOWN}


# --- plumbing ----------------------------------------------------------------------------------


def test_rows_meet_whatever_adaptive_execution_does(spark, docs):
    """Rows of a key stay in one partition above a join on that key, which Spark may turn and read locally."""
    from pyspark import TaskContext

    def where(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("band"), pa.array([TaskContext.get().partitionId()] * batch.num_rows)], ["band", "part"])

    rows = spark.range(20_000).select((F.col("id") % 500).alias("band"), "id")
    sizes = rows.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    met = B.together(rows.join(sizes, "band"), 4, "band").mapInArrow(where, "band bigint, part bigint")
    assert met.count() == 20_000 and met.groupBy("band").agg(F.count_distinct("part").alias("p")).filter("p > 1").count() == 0


def test_a_hash_threshold_keeps_the_smallest(spark):
    for total in (50, 5000, 200_000):
        rows = spark.range(total).select(B.place_of("id").alias("h"))
        kept = rows.filter(B.among_smallest(F.col("h"), 200, F.lit(float(total))))
        smallest = [r[0] for r in rows.orderBy("h").limit(200).collect()]
        left = {r[0] for r in kept.collect()}
        assert set(smallest) <= left and len(left) <= min(total, 700)
