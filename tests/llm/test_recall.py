"""Operator 8 against an exact join of the whole 0.1 table and near copies of it: every link, whatever pruning
and buckets do."""

import os
import random
import re
from collections import Counter, defaultdict

import pytest

from panelcast.llm import near_dup

PATH = "/root/testdata/sf0.1/documents.parquet"


def exact_links(texts, words=5):
    """{(i, j)} of the distinct sets with a similarity of 0.8 or more, and the set number of each text.

    Two such sets share one of the rarest shingles of the smaller: its size less four fifths of it, and one.
    """
    numbers, sets, of = {}, [], []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        s = frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else ())
        of.append(numbers.setdefault(s, len(sets)) if s else None)
        if s and numbers[s] == len(sets):
            sets.append(s)
    seen = Counter(g for s in sets for g in s)
    index, links = defaultdict(list), set()
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        s = sets[i]
        rare = sorted(s, key=lambda g: (seen[g], g))[: len(s) - (4 * len(s) + 4) // 5 + 1]
        for j in {j for g in rare for j in index[g]}:
            common = len(s & sets[j])
            if 5 * common >= 4 * (len(s) + len(sets[j]) - common):
                links.add((j, i))
        for g in rare:
            index[g].append(i)
    return links, of


def near_copies(rows, n, seed):
    """(id, text) of ``n`` copies with words changed, most of them near a similarity of 0.8 on either side."""
    rng, out = random.Random(seed), []
    long = [r.text for r in rows if len((r.text or "").split()) > 60]
    for i in range(n):
        w = rng.choice(long).split()
        for _ in range(max(1, round(len(w) * rng.uniform(0.005, 0.035)))):
            w[rng.randrange(len(w))] = f"changed{rng.randrange(10**9)}"
        out.append((10**6 + i, " ".join(w)))
    return out


def test_no_link_is_lost(spark, docs):
    if not os.path.exists(PATH):
        pytest.skip("test data not found")
    frame = spark.read.parquet(PATH).select("doc_id", "text")
    rows = frame.collect()
    frame = frame.unionAll(spark.createDataFrame(near_copies(rows, 4000, 1), "doc_id bigint, text string")).repartition(8)
    rows = frame.collect()
    links, of = exact_links([r.text for r in rows])
    copies = Counter(k for k in of if k is not None)
    degree = Counter()
    for i, j in links:
        degree[i] += copies[j]
        degree[j] += copies[i]
    root = {k: k for k in copies}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, j in links:
        root[find(i)] = find(j)
    first = {}
    for r, k in zip(rows, of):
        if k is not None:
            first[find(k)] = min(first.get(find(k), r.doc_id), r.doc_id)
    got = {r.doc_id: r for r in near_dup.report(near_dup.join(frame)).collect()}
    asked = sum(degree[k] + copies[k] - 1 for k in of if k is not None)
    found = sum(r.n_links for r in got.values())
    assert len(links) > 1000 and found == asked, f"{found} of {asked} ends of links"
    for r, k in zip(rows, of):
        want = (first[find(k)], degree[k] + copies[k] - 1) if k is not None else (r.doc_id, 0)
        assert (got[r.doc_id].class_id, got[r.doc_id].n_links) == want
