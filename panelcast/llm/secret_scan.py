"""Operator 1: secret scans, by fixed patterns and a character convolutional network.

Base findings are the leftmost non-overlapping matches of three patterns (``assign``, ``access``,
``hex``). Beyond them, every candidate (a run of 16 or more characters that tokens are made of,
with a letter and a digit) is read with its surrounding context by a convolutional network in
numpy: embedded characters, one convolution, maximum and mean over the places, a logistic output.
Candidates longer than ``READ`` are read whole in pieces of that length, one every ``STEP`` characters;
a piece that scores counts as far as the next ``/``, ``=`` or ``.`` on both sides, and what overlaps is one
finding. Base findings are cut out of a candidate first: what is left of it in stretches of 16 characters
or more is scored, with the base finding as context; candidates at or above the threshold get kind
``model``. The values of base findings are candidates as well and are scored alike; whatever the network
says of them, base findings stay, with its score and verdict beside them.

The network is trained (``fit``) on all distinct labelled findings of the corpus itself: the values of base
findings are secrets, candidates that touch no base finding are not. They are dealt by a hash into blocks of
about ``SAMPLE`` of each kind (a kind with fewer blocks' worth is repeated), so neither partitions nor order
matter; in every round all blocks train from the same weights, whose mean the next round starts from. In a
block both labels get contexts drawn from the same pool, so that a keyword before a value tells nothing.
Findings and secrets inside longer runs from a seeded generator join every block, for kinds of secrets the
corpus lacks. Scores are calibrated on a part held out (the mean of the blocks' calibrations), and the threshold
of each family of candidates is the highest that keeps ``RECALL`` of that part's secrets, each with all its
characters: of every kind of the corpus, counted over all blocks, of the generator's whole candidates and of
those inside a longer run. With few of a kind held out, none is lost.

Spans are code points, end exclusive. Defined results: null text is the empty text (no findings);
rows are scanned one by one, so repeated rows, null ids and extra columns need no care; an empty table
gives an empty table (and a network trained on the generator alone); texts are scanned whole, in pieces
of about a megabyte of whole documents, a very long one at once.
"""

from __future__ import annotations

import base64
import functools
import itertools
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm import _base as B
from panelcast.llm import _text as T

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "model")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

SHORTEST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{14,}[A-Za-z0-9+/_=-]")
_SEPARATOR = re.compile("[/=.]")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
LEFT, HEAD, TAIL, RIGHT = 24, 28, 12, 12
READ, STEP = HEAD + TAIL, 12
PLACES = LEFT + READ + RIGHT
WIDTH, EMBED, FILTERS = 5, 8, 24
#: Pieces the network reads at once: its arrays stay below the threshold for mappings.
SLICE = 64
RECALL = 0.97
#: Findings of each kind in a block of training; a longer finding than LONGEST counts as much as one of that length.
SAMPLE, LONGEST = 1000, 400
#: Tasks a round of training has at most: each sends one sum of weights to the driver.
TASKS = 256
_CODES = 130  # ASCII, anything else, no character


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # a run of 24 or more is a maximal run, so the shorter ones need no visit
    out += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]


def uncovered(start: int, end: int, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What is left of a candidate beside the base findings (sorted), in stretches of ``SHORTEST`` or more."""
    out, at = [], start
    for a, b, _ in (*base, (end, end, "")):
        if a >= end or b > at:
            if min(a, end) - at >= SHORTEST:
                out.append((at, min(a, end)))
            at = max(at, b)
    return out


def window(text: str, start: int, end: int) -> np.ndarray:
    """Character codes: left context, the candidate's head and tail, right context."""
    left = text[max(0, start - LEFT) : start].rjust(LEFT, "\0")
    body = text[start:end]
    head = body[:HEAD].ljust(HEAD, "\0")
    tail = body[HEAD:][-TAIL:].rjust(TAIL, "\0")
    raw = (left + head + tail + text[end : end + RIGHT].ljust(RIGHT, "\0")).encode("utf-32-le", "replace")
    return _coded(raw)


def _coded(raw: bytes) -> np.ndarray:
    codes = np.frombuffer(raw, np.uint32)
    return np.where(codes == 0, 129, np.minimum(codes, 128)).astype(np.int16)


def family(body: str) -> int:
    """Candidates get a threshold each by length: short ones are harder to tell, long ones have several pieces."""
    return (len(body) >= 32) + (len(body) > READ)


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """The pieces a candidate is read in: together all of it."""
    if end - start <= READ:
        return [(start, end)]
    return [(a, a + READ) for a in (*range(start, end - READ, STEP), end - READ)]


def windows(text: str, start: int, end: int) -> np.ndarray:
    """``window`` of each piece of a candidate."""
    if end - start <= READ:
        return window(text, start, end)[None].astype(np.uint8)
    around = text[max(0, start - LEFT) : start].rjust(LEFT, "\0") + text[start:end] + text[end : end + RIGHT].ljust(RIGHT, "\0")
    codes = _coded(around.encode("utf-32-le", "replace")).astype(np.uint8)
    return np.stack([codes[a - start : a - start + PLACES] for a, _ in pieces(start, end)])


def stretched(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The pieces of a candidate, each as far as the next separators."""
    cuts = [start - 1, *(m.start() for m in _SEPARATOR.finditer(text, start, end)), end]
    return [(cuts[bisect_left(cuts, a) - 1] + 1, cuts[bisect_left(cuts, b)]) for a, b in pieces(start, end)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def least_score(spans: list[tuple[int, int]], scores: np.ndarray, at: int, to: int) -> float:
    """The highest threshold at which the spans that score cover all of at..to."""
    best = np.zeros(to - at)
    # pieces between the same separators have one span: visited once, however long it is
    for (a, b), same in itertools.groupby(zip(spans, scores), itemgetter(0)):
        part = best[max(a - at, 0) : max(b - at, 0)]
        np.maximum(part, max(p for _, p in same), out=part)
    return float(best.min())


@dataclass
class Network:
    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: tuple[float, ...] = (0.5, 0.5, 0.5)

    @classmethod
    def new(cls, rng: np.random.Generator) -> Network:
        n = WIDTH * (EMBED + 1)
        return cls(rng.normal(0, 0.3, (_CODES, EMBED)), rng.normal(0, (2 / n) ** 0.5, (n, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), np.zeros(1))

    def _input(self, codes: np.ndarray) -> np.ndarray:
        own = np.zeros((*codes.shape, 1), self.embed.dtype)
        own[:, LEFT : LEFT + READ] = 1  # which places are the candidate's
        return np.concatenate([self.embed[codes], own], axis=2)

    def forward(self, codes: np.ndarray):
        x = self._input(codes)
        n = PLACES - WIDTH + 1
        cols = np.concatenate([x[:, j : j + n] for j in range(WIDTH)], axis=2)
        z = np.maximum(cols @ self.conv + self.bias, 0)
        top = z.argmax(1)
        pooled = np.concatenate([np.take_along_axis(z, top[:, None], 1)[:, 0], z.mean(1)], axis=1)
        return cols, z, top, pooled, pooled @ self.out + self.shift

    def step(self, codes: np.ndarray, labels: np.ndarray, shares: np.ndarray | None = None) -> list[np.ndarray]:
        """Gradients of the log loss, the mean of all or their sum by ``shares``, in the order of ``weights``."""
        cols, z, top, pooled, logit = self.forward(codes)
        g = (1 / (1 + np.exp(-logit)) - labels) * (1 / len(labels) if shares is None else shares)
        d_out, d_shift = pooled.T @ g, np.array([g.sum()])
        d_pool = g[:, None] * self.out
        d_z = np.repeat(d_pool[:, None, FILTERS:] / z.shape[1], z.shape[1], axis=1)
        rows, filters = np.indices(top.shape)
        d_z[rows, top, filters] += d_pool[:, :FILTERS]
        d_z *= z > 0
        d_conv, d_bias = np.einsum("npc,npf->cf", cols, d_z, optimize=True), d_z.sum((0, 1))
        d_cols = d_z @ self.conv.T
        d_x = np.zeros((*codes.shape, EMBED + 1), self.embed.dtype)
        for j in range(WIDTH):
            d_x[:, j : j + z.shape[1]] += d_cols[:, :, j * (EMBED + 1) : (j + 1) * (EMBED + 1)]
        d_embed = np.stack([np.bincount(codes.ravel(), d_x[:, :, e].ravel(), _CODES) for e in range(EMBED)], axis=1)
        return [d_embed, d_conv, d_bias, d_out, d_shift]

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.bias, self.out, self.shift]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.float32), *(self.forward(codes[i : i + SLICE])[-1] for i in range(0, len(codes), SLICE))])

    def probability(self, codes: np.ndarray) -> np.ndarray:
        """Calibrated probability that a candidate is a secret."""
        a, b = self.scale
        return 1 / (1 + np.exp(-(a * self.logits(codes) + b)))

    def accepts(self, codes: np.ndarray, bodies: list[str]) -> np.ndarray:
        return self.probability(codes) >= np.array([self.thresholds[family(x)] for x in bodies])


def _makers(rng: random.Random):
    """What findings are generated from: a choice, characters, a word, a secret, something else."""
    pick = rng.choice
    draw = lambda chars, a, b: "".join(rng.choices(chars, k=rng.randint(a, b)))
    alnum = string.ascii_letters + string.digits
    syllables = [a + b for a in "bcdfghlmnprstw" for b in ("a", "e", "i", "o", "u", "an", "er", "in", "on", "st")]
    word = lambda a=1, b=4: draw(syllables, a, b)

    def secret() -> str:
        kind = rng.randrange(6)
        if kind == 0:
            return pick(["ghp_", "gho_", "sk_live_", "sk-", "pk_test_", "xoxb-", "glpat-", ""]) + draw(alnum, 20, 44)
        if kind == 1:
            return base64.b64encode(rng.randbytes(rng.randrange(15, 48))).decode()
        if kind == 2:
            return ".".join("ey" + draw(alnum + "-_", 18, 40) for _ in range(2)) + "." + draw(alnum + "-_", 20, 43)
        if kind == 3:
            return draw(string.ascii_uppercase + string.digits, 16, 40)
        if kind == 4:
            return draw(pick([string.hexdigits, "0123456789abcdef"]), 20, 64)
        return draw(alnum + "+/_-", 18, 64)

    def other() -> str:
        kind = rng.randrange(8)
        number = str(rng.randrange(1, 10_000))
        if kind == 0:
            return f"{word()}{number}.{word(1, 3)}.{pick(['com', 'org', 'net', 'de', 'io'])}"
        if kind == 1:
            return "/".join(word() for _ in range(rng.randrange(2, 6))) + f"/{number}"
        if kind == 2:
            return pick("-_.").join([word(), word(), number, word()])
        if kind == 3:
            return f"20{rng.randrange(10, 30)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}T{rng.randrange(0, 24):02d}-{rng.randrange(0, 60):02d}-00"
        if kind == 4:
            return word(5, 12).capitalize() + number
        if kind == 5:
            return "".join(word(1, 3).capitalize() for _ in range(4)) + pick(["", number]) + pick("0123456789")
        if kind == 6:
            return f"{word()}-{word()}-v{rng.randrange(1, 9)}.{rng.randrange(0, 20)}.{rng.randrange(0, 20)}.{pick(['tar', 'zip', 'whl', 'jar', 'md'])}"
        return pick("=-_.") * rng.randrange(8, 30) + word() + number

    return pick, draw, word, secret, other


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of ``n`` generated findings, half of them secrets."""
    pick, _, word, secret, other = _makers(random.Random(seed))
    out = []
    while len(out) < n:
        label = len(out) % 2
        body = secret() if label else other()
        if not is_candidate(body):
            continue
        around = " ".join(word() for _ in range(4))
        lead = pick(["key: ", "auth ", "bearer ", '"', "credential='", "see ", "http://", "@", "file ", " ", " ", ""])  # alike for both labels
        text = f"{around} {lead}{body}{pick([' ', '\"', ',', chr(10), ''])} {word()} {word()}"
        at = text.index(body)
        out.append((text, at, at + len(body), label))
    return out


def labelled_runs(n: int, seed: int) -> list[tuple[str, int, int, int, int]]:
    """(text, start, end, at, to) of ``n`` generated runs of several segments, as many of each family; half hold a secret at at..to, in the others at is to."""
    rng = random.Random(seed)
    pick, draw, word, secret, other = _makers(rng)

    def segment() -> str:
        kind = rng.randrange(8)
        if kind == 0:
            return other()
        if kind == 1:
            return draw(string.ascii_uppercase + string.digits, 2, 10)
        if kind == 2:
            return draw("0123456789abcdef", 6, 12)
        if kind == 3:
            return str(rng.randrange(1, 10**6))
        if kind == 4:
            return f"{pick(['api.', 'www.', ''])}{word()}.{pick(['com', 'org', 'net', 'de', 'io', 'example'])}"
        return pick("-_").join(word() for _ in range(rng.randrange(1, 5)))

    out = []
    while len(out) < n:
        label, most = len(out) % 2, pick((2, 2, 6))
        before = "".join(segment() + pick("///=._-") for _ in range(rng.randrange(0, most)))
        after = "".join(pick("///=._-") + segment() for _ in range(rng.randrange(0 if before else 1, most)))
        before = pick(["//", "/", "", ""]) + before
        body = secret() if label else segment()
        run = before + body + after
        if label and not (len(body) >= SHORTEST and re.search("[0-9]", body) and re.search("[A-Za-z]", body)):
            continue
        if family(run) != len(out) // 2 % 3 or not is_candidate(run):
            continue
        lead = f"{word()} {word()} {pick(['see ', 'https:', '(', '@', chr(34), ' ', ' '])}"
        at = len(lead) + len(before)
        out.append((f"{lead}{run}{pick([' ', chr(34), ',', ')', chr(10), ''])} {word()} {word()}", len(lead), len(lead) + len(run), at, at + len(body) * label))
    return out


def kept_rank(n: int) -> int:
    """How many of ``n`` secrets the highest threshold that keeps ``RECALL`` of secrets like these loses: half as
    many of them as may be lost."""
    return int((1 - RECALL) / 2 * n)


def keeping(scores: list[float]) -> float:
    return float(sorted(scores)[kept_rank(len(scores))])


def corpus_findings(rows: list[tuple[str, str, str, str]], seed: int | list[int]) -> list[tuple[str, int, int, int, int]]:
    """(text, start, end, at, to) of findings (kind, left, body, right), as ``labelled_runs`` gives them; contexts
    are dealt anew among all of them."""
    rng = np.random.default_rng(seed)
    out = []
    for (kind, _, body, _), i in zip(rows, rng.permutation(len(rows)).tolist()):
        _, left, _, right = rows[i]
        out.append((left + body + right, len(left), len(left) + len(body), len(left), len(left) + len(body) * (kind != "none")))
    return out


#: Pieces' codes, labels, weights, and whether they are learned from or else held out.
Lesson = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Examples:
    """Findings (text, start, end, at, to) in pieces; those not in ``learn`` are held out."""

    def __init__(self, found: list[tuple[str, int, int, int, int]], learn: np.ndarray) -> None:
        self.found, self.learn = found, learn
        read = [pieces(a, b) for _, a, b, _, _ in found]
        sizes = np.array([len(x) for x in read], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.codes = np.concatenate([np.zeros((0, PLACES), np.uint8), *(windows(t, a, b) for t, a, b, _, _ in found)])
        # of a secret, a piece holds all or SHORTEST characters (1), none (0), or too little to be learned from
        self.held = np.array([max(0, min(b, to) - max(a, at)) for (_, _, _, at, to), spans in zip(found, read) for a, b in spans], np.int64)
        self.weight = np.repeat(np.minimum(1, len(pieces(0, LONGEST)) / np.maximum(sizes, 1)), sizes)

    def lesson(self) -> Lesson:
        clear = (self.held == 0) | (self.held >= SHORTEST)
        learn = np.repeat(self.learn, np.diff(self.first))
        return self.codes[clear], (self.held > 0)[clear].astype(float), self.weight[clear], learn[clear]

    def least(self, net: Network, of: np.ndarray) -> Iterator[tuple[int, float]]:
        """(finding's number, score at which all its characters are covered) of the held-out secrets in ``of``."""
        for k in np.flatnonzero(of & ~self.learn).tolist():
            text, a, b, at, to = self.found[k]
            if to > at:
                yield k, least_score(stretched(text, a, b), net.probability(self.codes[self.first[k] : self.first[k + 1]]), at, to)


def learned(state: list[np.ndarray], lesson: Lesson, at: int, rounds: int, seed: list[int]) -> list[np.ndarray]:
    """Weights, and the means of their gradients and of the squares, after round ``at`` of ``rounds``."""
    codes, labels, weight, learn = lesson
    state = [x.astype(np.float32) for x in state]
    n = len(state) // 3
    net = Network(*state[:n])
    own = np.random.default_rng(seed).permutation(np.flatnonzero(learn))
    upto = np.cumsum(weight[own])
    batches = max(1, int(upto[-1]) // 64) if len(own) else 0
    ends = np.searchsorted(upto, upto[-1:] * np.arange(1, batches) / max(1, batches)) + 1
    for t, batch in enumerate(np.split(own, ends)[:batches], at * batches + 1):
        rate = 0.006 * (1 - t / (rounds * batches + 1))  # smaller and smaller steps
        parts, total = np.split(batch, range(SLICE, len(batch), SLICE)), weight[batch].sum()
        steps = [net.step(codes[i], labels[i], weight[i] / total) for i in parts]
        for w, g, m, v in zip(state[:n], map(sum, zip(*steps)), state[n : 2 * n], state[2 * n :]):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return state


def untrained(seed: int) -> list[np.ndarray]:
    weights = [w.astype(np.float32) for w in Network.new(np.random.default_rng(seed)).weights]
    return weights + [np.zeros_like(w) for w in weights * 2]


def calibrated(net: Network, lesson: Lesson) -> tuple[float, float]:
    """Platt scaling on what is held out: a logistic regression on the scores."""
    codes, y, weight, learn = lesson
    logit, y, weight, a, b = net.logits(codes[~learn]), y[~learn], weight[~learn], 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * logit + b)))
        a -= 0.05 * float(np.average((p - y) * logit, weights=weight))
        b -= 0.5 * float(np.average(p - y, weights=weight))
    return a, b


@functools.lru_cache(2)
def generated(n: int, seed: int) -> Examples:
    """``n`` generated findings and as many runs."""
    found = [(t, a, b, a, b if y else a) for t, a, b, y in labelled_findings(n, seed)] + labelled_runs(n, seed + 1)
    return Examples(found, np.arange(2 * n) % 4 < 2 if n < 200 else np.random.default_rng(seed).random(2 * n) < 0.6)


def limited(net: Network, made: Examples, corpus: dict[tuple[int, str], float]) -> Network:
    """``net`` with the thresholds of its families: the least of every kind's, by (family, kind) for the corpus's."""
    kept: dict[tuple, list[float]] = {}
    for k, score in made.least(net, np.ones(len(made.found), bool)):
        text, a, b, at, to = made.found[k]
        kept.setdefault((family(text[a:b]), to - at < b - a), []).append(score)
    least = [(f, keeping(x)) for (f, _), x in kept.items()] + [(f, x) for (f, _), x in corpus.items()]
    net.thresholds = tuple(min((x for f, x in least if f == i), default=0.5) for i in range(len(net.thresholds)))
    return net


@functools.lru_cache(8)
def network(n: int = 6000, seed: int = 7, rounds: int = 7) -> Network:
    """Trained on part of ``n`` generated findings and runs each, calibrated and given thresholds on the rest."""
    made, state = generated(n, seed), untrained(seed)
    lesson = made.lesson()
    for i in range(rounds):
        state = learned(state, lesson, i, rounds, [seed, 0, i])
    net = Network(*state[: len(state) // 3])
    net.scale = calibrated(net, lesson)
    return limited(net, made, {})


def is_candidate(body: str) -> bool:
    return bool(CANDIDATE.fullmatch(body) and re.search("[0-9]", body) and re.search("[A-Za-z]", body))


def values(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, tuple[int, int, str]]]:
    """(start, end, finding) of the values of base findings that are candidates."""
    out = []
    for f in base:
        a = ASSIGN.match(text, f[0]).start(2) if f[2] == "assign" else f[0]
        if is_candidate(text[a : f[1]]):
            out.append((a, f[1], f))
    return out


def labelled(texts: pa.Array) -> Iterator[tuple[str, str, str, str]]:
    """(kind, left, body, right): values of base findings by kind, and candidates that touch none (none)."""
    for i in suspects(texts).tolist():
        text = texts[i].as_py()
        base = base_findings(text)
        spans = [(a, b, f[2]) for a, b, f in values(text, base)]
        starts, most = [f[0] for f in base], list(itertools.accumulate((f[1] for f in base), max))
        for a, b in candidates(text):
            k = bisect_left(starts, b)  # base findings that start before the candidate's end
            if not k or most[k - 1] <= a:
                spans.append((a, b, "none"))
        for a, b, kind in spans:
            yield kind, text[max(0, a - LEFT) : a], text[a:b], text[b : b + RIGHT]


_FOUND = ["kind", "lead", "body", "tail"]


def _block_examples(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[int, list[tuple], Examples]]:
    """(block, its rows, their examples) of a task's rows, which come sorted."""
    rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("block", "first", "h", *_FOUND))))
    for block, group in itertools.groupby(rows, itemgetter(0)):
        mine = list(group)
        learn = np.array([(r[2] >> 33) % 10 < 6 for r in mine])
        yield block, mine, Examples(corpus_findings([r[3:] for r in mine], [seed, block]), learn)


def fit(df: DataFrame, text_col: str = "text", sample: int = SAMPLE, seed: int = 7, rounds: int = 7) -> Network:
    """A network trained on all distinct findings, in blocks of about ``sample`` of each kind (see the module's text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in itertools.batched(labelled(B.text_array(batch, "text")), B.BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], _FOUND)

    found = df.select(F.col(text_col).alias("text")).mapInArrow(find, ", ".join(f"{c} string" for c in _FOUND)).distinct()
    found = B.checkpointed(found.select("*", B.place_of(*_FOUND).alias("h")))
    parts = {kind: -(-n // sample) for kind, n in found.groupBy("kind").count().collect()}  # a number a kind
    if not parts:
        return network(seed=seed, rounds=rounds)
    blocks = max(parts.values())
    of_kind = F.coalesce(*(F.when(F.col("kind") == kind, F.lit(n).cast("long")) for kind, n in parts.items()))
    # a kind with fewer parts than there are blocks: its parts come again and again
    own, every = F.pmod("h", of_kind), F.lit(blocks - 1).cast("long")
    dealt = found.select("h", *_FOUND, own.alias("own"), F.explode(F.sequence(own, every, of_kind)).alias("block"))
    dealt = dealt.select("block", (F.col("block") == F.col("own")).alias("first"), "h", *_FOUND)
    tasks = min(blocks, TASKS)
    dealt = B.checkpointed(dealt.repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int")).sortWithinPartitions("block", "h", *_FOUND))
    made, state = generated(6000, seed), untrained(seed)
    shared = df.sparkSession.sparkContext.broadcast(made.lesson())  # of fixed size

    def lessons(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Lesson]]:
        for block, _, examples in _block_examples(batches, seed):
            yield block, tuple(np.concatenate(x) for x in zip(shared.value, examples.lesson()))

    def mean_of(of_block) -> np.ndarray:
        """The mean of ``of_block`` (block, lesson) over all blocks, added up in their order."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = 0.0, 0
            for block, lesson in lessons(batches):
                total, n = total + of_block(block, lesson), n + 1
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        sums = dealt.mapInArrow(run, "total binary").collect()  # one a task
        return sum(np.frombuffer(r.total) for r in sums) / blocks

    def flat(arrays: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([x.ravel() for x in arrays]).astype(np.float64)

    # between rounds the blocks meet; one block needs no meeting
    for some in [range(rounds)] if blocks == 1 else [range(i, i + 1) for i in range(rounds)]:

        def study(block: int, lesson: Lesson, mine: list[np.ndarray] = state, some: range = some) -> np.ndarray:
            for i in some:
                mine = learned(mine, lesson, i, rounds, [seed, block, i])
            return flat(mine)

        ends = np.cumsum([x.size for x in state])[:-1]
        state = [x.reshape(y.shape).astype(np.float32) for x, y in zip(np.split(mean_of(study), ends), state)]
    net = Network(*state[: len(state) // 3])
    net.scale = tuple(mean_of(lambda block, lesson: np.array(calibrated(net, lesson))).tolist())
    return limited(net, made, _corpus_thresholds(dealt, net, seed))


def _corpus_thresholds(dealt: DataFrame, net: Network, seed: int) -> dict[tuple[int, str], float]:
    """By (family, kind), the highest threshold that keeps the recall of the corpus's held-out secrets, each met once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, examples in _block_examples(batches, seed):
            out = [(family(rows[k][5]), rows[k][3], score) for k, score in examples.least(net, np.array([r[1] for r in rows]))]
            if out:
                families, kinds, scores = zip(*out)
                # the bits of non-negative floats are in the floats' order
                bits = np.array(scores, np.float32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(families, pa.int32()), pa.array(kinds, pa.string()), pa.array(bits)], ["family", "kind", "bits"])

    scored = B.checkpointed(dealt.mapInArrow(run, "family int, kind string, bits int"))
    upper = F.shiftright("bits", 16).alias("part")
    found: dict[tuple[int, str], tuple[int, int]] = {}  # the upper half of each threshold's bits, its rank among those
    counts = scored.groupBy("family", "kind", upper).count().orderBy("family", "kind", "part").collect()  # at most 2**14 a group
    for key, group in itertools.groupby(counts, itemgetter(0, 1)):
        found[key] = _ranked(list(group), None)
    if not found:
        return {}
    asked = functools.reduce(Column.__or__, ((F.col("family") == f) & (F.col("kind") == k) & (upper == part) for (f, k), (part, _) in found.items()))
    lower = F.col("bits").bitwiseAND(0xFFFF).alias("part")
    counts = scored.filter(asked).groupBy("family", "kind", lower).count().orderBy("family", "kind", "part").collect()  # at most 2**16 a group
    out = {}
    for key, group in itertools.groupby(counts, itemgetter(0, 1)):
        part, rank = found[key]
        out[key] = float(np.array([part << 16 | _ranked(list(group), rank)[0]], np.int32).view(np.float32)[0])
    return out


def _ranked(counts: list[tuple], rank: int | None) -> tuple[int, int]:
    """(value, rank among equals) of the row of ``rank``, or of ``kept_rank``, among sorted (.., value, count)."""
    rank = kept_rank(sum(r[3] for r in counts)) if rank is None else rank
    for _, _, value, n in counts:
        if rank < n:
            return value, rank
        rank -= n
    raise AssertionError("a rank beyond all rows")


_TOKEN = np.isin(np.arange(256), list(b"+/_.=-" + string.ascii_letters.encode() + string.digits.encode()))
_DIGIT = np.isin(np.arange(256), list(string.digits.encode()))
_HEXES = np.isin(np.arange(256), list(b"0123456789abcdef"))


def _runs(member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], member.view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def suspects(texts: pa.Array) -> np.ndarray:
    """Indices of the texts that can hold a finding; all others surely hold none."""
    data, offsets = T.buffers(texts)
    found, at = [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + T.PIECE, "right")) - 1)
        piece = data[offsets[at] : offsets[to]]
        places = [np.zeros(0, np.int64)]
        starts, ends = _runs(_TOKEN[piece], SHORTEST)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[piece])])
        with_digit = digits[ends] > digits[starts]
        # a run may reach over texts without a gap between them: all of those are looked at
        for starts, ends in ((starts[with_digit], ends[with_digit]), _runs(_HEXES[piece], LEAST["hex"])):
            first, last = (np.searchsorted(offsets, x + offsets[at], "right") - 1 for x in (starts, ends - 1))
            found += [np.arange(a, b + 1) for a, b in zip(first.tolist(), last.tolist())]
        raw = piece.tobytes()
        low = raw.lower()
        for key, where in ((b"AKIA", raw), *((k, low) for k in KEYWORDS)):
            i = where.find(key)
            while i >= 0:
                places.append(np.array([i]))
                i = where.find(key, i + 1)
        found.append(np.searchsorted(offsets, np.concatenate(places) + offsets[at], "right") - 1)
        at = to
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _asked_pieces(asked: list[tuple[int, str, int, int]]) -> Iterator[tuple]:
    """(text's index, text, candidate, piece, (candidate's start, the piece's span)) of all pieces of all candidates."""
    for i, text, a, b in asked:
        body = text[a:b]
        for piece, span in zip(pieces(a, b), stretched(text, a, b)):
            yield i, text, body, piece, (a, span)


def uncovered_of(found: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """``uncovered`` of all candidates of a text, each met with the base findings near it only."""
    starts, most = [f[0] for f in base], list(itertools.accumulate((f[1] for f in base), max))
    for a, b in found:
        # base findings that start before the candidate's end, from the first on that reaches it
        yield from uncovered(a, b, base[bisect_right(most, a) : bisect_left(starts, b)])


def scan_texts(texts: pa.Array, net: Network, verdicts: dict | None = None) -> dict[int, list[tuple[int, int, str]]]:
    """Findings (start, end, kind), sorted, of the texts that have any; ``verdicts`` gets, by (text, finding),
    the network's (score, whether it accepts it) of what it read."""
    found, asked, own = {}, [], []
    for i in suspects(texts).tolist():
        text = texts[i].as_py()
        base = base_findings(text)
        if base:
            found[i] = base
            own += [(i, text, a, b, f) for a, b, f in values(text, base)] if verdicts is not None else []
        asked += [(i, text, a, b) for a, b in uncovered_of(candidates(text), base)]
    for part in itertools.batched(own, 1024):
        read = [(i, f, window(text, *piece), family(text[a:b])) for i, text, a, b, f in part for piece in pieces(a, b)]
        for (i, f, _, kind), p in zip(read, net.probability(np.stack([w for _, _, w, _ in read])).tolist()):
            score, yes = verdicts.get((i, f), (0.0, False))
            verdicts[i, f] = (max(score, p), yes or p >= net.thresholds[kind])
    scored: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for part in itertools.batched(_asked_pieces(asked), 4096):
        scores = net.probability(np.stack([window(text, *piece) for _, text, _, piece, _ in part])).tolist()
        for (i, _, body, _, (key, span)), p in zip(part, scores):
            if p >= net.thresholds[family(body)]:
                scored.setdefault((i, key), []).append((*span, p))
    for (i, _), spans in scored.items():
        whole = [(a, b, "model") for a, b in merged([x[:2] for x in spans])]
        found.setdefault(i, []).extend(whole)
        if verdicts is not None:
            verdicts.update({(i, f): (max(p for a, b, p in spans if a < f[1] and f[0] < b), True) for f in whole})
    return {i: sorted(f, key=lambda s: (s[0], KINDS.index(s[2]))) for i, f in found.items()}


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: Network | None = None) -> DataFrame:
    """(id, findings array<struct<kind, start, end, score, accepted>>) of every row; ``score`` and ``accepted`` are
    the network's, null for base findings without a candidate. Without ``net``, one is fitted to ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(net or fit(df, text_col))  # of fixed size
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("accepted", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts: dict = {}
            found = scan_texts(B.text_array(batch, "text"), shared.value, verdicts)
            lists: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, spans in found.items():
                for f in spans:
                    score, yes = verdicts.get((i, f), (None, None))
                    lists[i].append({"kind": f[2], "start": f[0], "end": f[1], "score": score, "accepted": yes})
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lists, pa.list_(item))], ["id", "findings"])

    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, findings array<struct<kind:string,start:bigint,end:bigint,score:double,accepted:boolean>>").withColumnRenamed("id", id_col)


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from the operator's findings, and how many base findings the network read and accepts."""
    base = F.filter("findings", lambda f: f["kind"] != "model")
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    return scanned.select(
        F.col(id_col),
        *map(count, KINDS[:3]),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
        count("model"),
        F.size(F.filter("findings", lambda f: (f["kind"] != "model") & f["score"].isNotNull())).cast("long").alias("n_read"),
        F.size(F.filter("findings", lambda f: (f["kind"] != "model") & f["accepted"])).cast("long").alias("n_confirmed"),
    )


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", net: Network | None = None) -> DataFrame:
    """``df`` with every finding in the text replaced by ``mark``; null stays null, all columns stay. Without
    ``net``, one is fitted to ``df``."""
    shared, place = df.sparkSession.sparkContext.broadcast(net or fit(df, text_col)), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(place)
            found = scan_texts(col.fill_null("") if col.null_count else col, shared.value)
            if found:
                texts = col.to_pylist()
                for i, spans in found.items():
                    out, at = [], 0
                    for a, b, _ in spans:
                        if a >= at:
                            out += [texts[i][at:a], mark]
                        at = max(at, b)
                    texts[i] = "".join([*out, texts[i][at:]])
                batch = pa.RecordBatch.from_arrays([pa.array(texts, col.type) if j == place else c for j, c in enumerate(batch.columns)], schema=batch.schema)
            yield batch

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields))
