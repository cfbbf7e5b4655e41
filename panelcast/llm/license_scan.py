"""Operator 4: licence scans with a generalised suffix automaton.

The automaton holds every run of words of all licence templates: whole licence texts where they are
short, and the notices that stand for the long ones. A file's words stream through it; at each word it
yields the length of the longest run ending there that some template contains (matching statistics), and
its suffix links the shorter ones of the other templates. Of these, the maximal matches of ``MIN_MATCH``
words or more are chained, template by template: in a chain, places in file and template advance with
gaps of at most ``MAX_GAP`` words, and it covers each word of the template once. The chain that covers
most (of equal ones the first to end, then the first to start) is a span if it covers ``MIN_COVER`` of its template;
then the next one is sought on both sides of it.

Base phrases are found exactly as given (all places), apart from the automaton, and their labels
always stay. Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

Defined results: null text is the empty text (no words, no labels, score 0); rows are judged one by
one, so repeated rows, null ids and extra columns need no care; an empty table gives an empty table; texts
are scanned whole, a very long one with some 100 bytes a word at once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import _base as B

# The base phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAMES = "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_AS_IS = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"

# Whole texts of short public licences, by label.
LICENSES = [
    ("mit", f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software {_AS_IS}"),
    ("bsd-2-clause", f"{_BSD_GRANT} {_BSD_AS_IS}"),
    ("bsd-3-clause", f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_AS_IS}"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsl-1.0", "boost software license version 1.0 august 17th 2003 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("wtfpl", "do what the fuck you want to public license version 2 december 2004 everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed do what the fuck you want to public license terms and conditions for copying distribution and modification 0 you just do what the fuck you want to"),
]

# Well-known licence notices and characteristic passages, by label.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
TEMPLATES = NOTICES + LICENSES
MIN_MATCH = 3
MAX_GAP = 4
MIN_COVER = 0.75

_b = np.arange(256)
_low = np.where((_b >= 65) & (_b <= 90), _b + 32, _b)
#: Lower case; what no word holds becomes a space.
FOLD = np.where((_low >= 97) & (_low <= 122) | (_b >= 48) & (_b <= 57) | (_b >= 128), _low, 32).astype(np.uint8).tobytes()


def words(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


@dataclass
class Automaton:
    """A generalised suffix automaton over word numbers.

    Per state: next states, suffix link, longest length; for placing, one (template, end) where
    the state's runs occur and, through the links' tree, all the others.
    """

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def _state(self, size: int, link: int, nexts: dict[int, int]) -> int:
        self.next.append(nexts)
        self.link.append(link)
        self.size.append(size)
        self.ends.append(set())
        return len(self.size) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def add(self, template: int, run: list[int]) -> None:
        last = 0
        for at, w in enumerate(run):
            q = self.next[last].get(w)
            if q is not None:  # an earlier template has this run
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, w, q)
            else:
                new = self._state(self.size[last] + 1, 0, {})
                p = last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][w]
                    self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, w, q)
                last = new
            self.ends[last].add((template, at))

    def finish(self) -> None:
        """Hand each state's ends up its links, longest first."""
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            self.ends[self.link[s]] |= self.ends[s]

    def statistics(self, run: list[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest run ending at each word."""
        out, s, n = [], 0, 0
        for w in run:
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.size[s]
            if w in self.next[s]:
                s, n = self.next[s][w], n + 1
            else:
                s = n = 0
            out.append((n, s))
        return out


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]) -> None:
        self.labels = [label for label, _ in templates]
        runs = [words(text) for _, text in templates]
        self.sizes = [len(r) for r in runs]
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for r in runs for w in r))}
        self.auto = Automaton()
        pairs = np.zeros((len(self.number) + 1, len(self.number) + 1), bool)
        for t, r in enumerate(runs):
            ids = [self.number[w] for w in r]
            self.auto.add(t, ids)
            pairs[ids[:-1], ids[1:]] = True
        self.auto.finish()
        self.pairs = pairs  # word pairs that some template holds; the last row and column stay empty
        self.phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]
        self.phrase_bytes = [b" ".join(p) for p, _ in self.phrases]

    def matches(self, ws: list[bytes]) -> list[tuple[int, int, int, int]]:
        """All maximal matches of MIN_MATCH words or more: (template, first word, place in it, words)."""
        none = len(self.number)
        get = self.number.get
        ids = np.fromiter((get(w, none) for w in ws), np.int64, len(ws))
        good = np.flatnonzero(self.pairs[ids[:-1], ids[1:]]) if len(ids) > 1 else ids[:0]
        if not len(good):
            return []
        # every match of two words or more lies within a run of such pairs
        cuts = np.flatnonzero(np.diff(good) > 1)
        firsts, lasts = good[np.append(0, cuts + 1)], good[np.append(cuts, len(good) - 1)] + 2
        found = []
        for a, b in zip(firsts.tolist(), lasts.tolist()):
            if b - a < MIN_MATCH:
                continue
            before: dict[tuple[int, int], int] = {}  # (template, last place) to the words of the match that ends there
            for i, (n, s) in enumerate([*self.auto.statistics(ids[a:b].tolist()), (0, 0)], a):
                now = self._ending(n, s) if n >= MIN_MATCH else {}
                found += [(t, i - k, e + 1 - k, k) for (t, e), k in before.items() if (t, e + 1) not in now]
                before = now
        return found

    def _ending(self, n: int, s: int) -> dict[tuple[int, int], int]:
        """Where in the templates the words read so far end, and how many of them match there: the longest
        run's places have it whole, those that only a suffix link adds have that link's length."""
        out: dict[tuple[int, int], int] = {}
        while n >= MIN_MATCH:
            for place in self.auto.ends[s]:
                out.setdefault(place, n)
            s = self.auto.link[s]
            n = self.auto.size[s]
        return out

    def spans(self, ws: list[bytes]) -> list[tuple[int, int, str, float]]:
        """Chained template spans: (first word, end, label, part of the template covered)."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for t, at, place, n in self.matches(ws):
            by_template.setdefault(t, []).append((at, place, n))
        return sorted((a, b, self.labels[t], c / self.sizes[t]) for t, m in by_template.items() for a, b, c in chains(sorted(m), MIN_COVER * self.sizes[t]))

    def base(self, joined: bytes, ws: list[bytes]) -> list[tuple[int, str]]:
        """(first word, label) of every place of a base phrase."""
        out = []
        for raw, (phrase, label) in zip(self.phrase_bytes, self.phrases):
            if raw not in joined:
                continue
            k, at = len(phrase), -1
            try:
                while True:
                    at = ws.index(phrase[0], at + 1)
                    if ws[at : at + k] == phrase:
                        out.append((at, label))
            except ValueError:
                pass
        return out


def chains(matches: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int]]:
    """(first word, end, words covered) of the best chains of one template's sorted matches (at, place, n) that
    cover ``least`` words or more, none overlapping another in the file."""
    groups: list[list[tuple[int, int, int]]] = []
    furthest = 0
    for m in matches:  # no chain reaches over a wider gap than MAX_GAP
        if not groups or m[0] > furthest + MAX_GAP:
            groups.append([])
            furthest = 0
        groups[-1].append(m)
        furthest = max(furthest, m[0] + m[2])
    out = []
    while groups:
        group = groups.pop()
        if (best := best_chain(group))[2] >= least:
            out.append(best)
            groups += [g for g in ([m for m in group if m[0] + m[2] <= best[0]], [m for m in group if m[0] >= best[1]]) if g]
    return sorted(out)


def best_chain(matches: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """(first word, end, words covered) of the chain that covers most, the first to end, then to start, of equal ones."""
    best: list[tuple[int, int]] = []  # by match: (words covered, minus the first word) of the best chain that ends in it
    recent: list[int] = []
    for j, (at, place, n) in enumerate(matches):
        mine = (n, -at)
        recent = [i for i in recent if matches[i][0] + matches[i][2] + MAX_GAP >= at]
        for i in recent:
            a, p, k = matches[i]
            skip = max(0, a + k - at, p + k - place)  # words both matches hold
            if a < at and p < place and skip < n and place + skip - p - k <= MAX_GAP and at + skip - a - k <= MAX_GAP:
                mine = max(mine, (best[i][0] + n - skip, best[i][1]))
        best.append(mine)
        recent.append(j)
    j = min(range(len(matches)), key=lambda j: (-best[j][0], matches[j][0] + matches[j][2], -best[j][1]))
    return -best[j][1], matches[j][0] + matches[j][2], best[j][0]


@functools.cache
def scanner() -> Scanner:
    return Scanner(TEMPLATES)


def scan_text(text: str) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
    """(number of words, base places, template spans) of one text."""
    s = scanner()
    ws = words(text)
    return len(ws), s.base(b" ".join(ws), ws), s.spans(ws)


SCHEMA = "n_words bigint, base array<struct<start:bigint,label:string>>, spans array<struct<start:bigint,end:bigint,label:string,cover:double>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, base places, template spans) of every row."""
    base_t = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    span_t = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("cover", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(t) for t in B.text_array(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([[{"start": a, "label": b} for a, b in f[1]] for f in found], base_t),
                    pa.array([[dict(zip(("start", "end", "label", "cover"), s)) for s in f[2]] for f in found], span_t),
                ],
                ["id", "n_words", "base", "spans"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns; score is 1 with a base phrase, else the best template's covered part."""
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return scanned.select(
        F.col(id_col),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        labels(F.col("base.label")).alias("base_labels"),
        labels(F.concat("base.label", "spans.label")).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.cover"), F.lit(0.0))).alias("score"),
    )
