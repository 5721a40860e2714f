"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

Kernel: phi_u(x) of a string u of three letters is the sum, over its occurrences as a subsequence of x
within ``SPAN`` places, of ``DECAY`` to the letters skipped; k(x, y) is the inner product.  The ends of
a word count as letters.  Signs other than letters are taken out first, so characters inserted into a
word cost nothing if they are no letters, and decay if they are.

Landmarks are words and beginnings of words of the sample whose presence tells toxic documents from
others (log-likelihood ratio, with a limit that grows with the number of candidates; copies of a
document count once).  A sentence is compared with a landmark by its best word; K^(-1/2) of the
landmarks maps that to features.  The machine is trained on sentences: all of clean documents, and of
each toxic document those that hold a landmark and the one with the largest margin, chosen anew in
each round.  A document is scored
by a logistic curve over its largest sentence margin and over how many sentences come near it.

Only words with a kernel value of at least ``ACTIVE`` of some landmark count; the others' values are
zero, in training and in scoring.  So most words cost one table look-up.

A word's value against a landmark is k(word, landmark) / k(landmark, landmark), at most 1.5: what the word
holds of the landmark, whatever else it holds.  That is not the cosine which the landmarks' own matrix is
made of; with the cosine for both, an insult with an inserted letter falls below the threshold.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fold_of, text_bytes
from plumbline.llm.labelled import labelled_sample, to_driver
from plumbline.llm.textvec import LOWER

#: Labelled rows of each class, and their bytes at most.
MOST, MOST_BYTES = 1500, 12 << 20
LANDMARKS = 40
SPAN, DECAY, ACTIVE = 6, 0.7, 0.6
#: The kernel is raised to this power, which is a kernel again and tells near words from equal ones.
POWER = 2
PIECE, STEP = 40, 20
#: Words that a worker remembers (a second table holds those with a value).
WORDS = 400_000
#: Texts whose new words are compared with the landmarks together.
TOGETHER = 400

#: Byte -> letter code: a-z, digits, and the low four bits of bytes beyond ASCII; 0 is no letter.
CODES = np.zeros(256, dtype=np.int32)
CODES[0x61:0x7B] = np.arange(1, 27)
CODES[0x30:0x3A] = np.arange(27, 37)
CODES[0x80:] = 37 + (np.arange(0x80, 0x100) & 15)
#: The ends of a word.
FIRST, LAST = 0x01, 0x02
CODES[FIRST], CODES[LAST] = 53, 54
_BASE = 55
_OFFSETS = [(j, k) for j in range(1, SPAN - 1) for k in range(j + 1, SPAN)]
_SENTENCE = re.compile(rb"[.!?\n]+")
_TABLE = bytes(LOWER)
_SIGNS = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A))


def fold(text: bytes) -> bytes:
    return text.translate(_TABLE)


def ended(word: bytes) -> bytes:
    """The letters of a lower-case word between its ends."""
    return b"\x01" + word.translate(None, _SIGNS) + b"\x02"


def triples(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, triple, weight) of all subsequences of three letters within the span."""
    flat = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    lengths = np.array([len(w) for w in words], dtype=np.int64) + 1
    code = CODES[flat]
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat)) - 1  # places to the word's end
    who, what, weight = [], [], []
    n = len(flat)
    for j, k in _OFFSETS:
        if n <= k:
            continue
        ok = np.flatnonzero(left[: n - k] > k)
        who.append(owner[ok])
        what.append((code[ok] * _BASE + code[ok + j]) * _BASE + code[ok + k])
        weight.append(np.full(len(ok), DECAY ** (k - 2)))
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(who), np.concatenate(what), np.concatenate(weight)


class Kernel:
    """Kernel values of words against landmarks, each divided by the landmark's own."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        m = len(landmarks)
        who, what, weight = triples(landmarks)
        self.names, index = np.unique(what, return_inverse=True)
        phi = np.zeros((len(self.names), m))
        np.add.at(phi, (index, who), weight)
        self.own = (phi**2).sum(axis=0)
        self.phi = (phi / np.maximum(self.own, 1e-9)).astype(np.float32)
        self.most = self.phi.max(axis=1) if m else np.zeros(0)
        self.place = np.full(_BASE**3, -1, dtype=np.int32)
        self.place[self.names] = np.arange(len(self.names))
        gram = ((phi.T @ phi) / np.sqrt(np.outer(self.own, self.own) + 1e-12)) ** POWER if m else np.zeros((0, 0))
        values, vectors = np.linalg.eigh(gram + 1e-3 * np.eye(m)) if m else (np.zeros(0), np.zeros((0, 0)))
        self.root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T if m else gram

    def active(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words with a value of at least ``ACTIVE``, and their values."""
        m = len(self.landmarks)
        if not m or not words:
            return np.zeros(0, np.int64), np.zeros((0, m), np.float32)
        who, what, weight = triples(words)
        at = self.place[what]
        hit = np.flatnonzero(at >= 0)
        who, at, weight = who[hit], at[hit], weight[hit]
        # no landmark's value is above the sum of each triple's largest share
        bound = np.bincount(who, weights=weight * self.most[at], minlength=len(words))
        hit = np.flatnonzero(bound[who] >= ACTIVE)
        order = hit[np.argsort(who[hit], kind="stable")]
        if not len(order):
            return np.zeros(0, np.int64), np.zeros((0, m), np.float32)
        own = who[order]
        begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        values = np.minimum(np.add.reduceat(self.phi[at[order]] * weight[order, None].astype(np.float32), begins, axis=0), 1.5)
        some = values.max(axis=1) >= ACTIVE
        return own[begins][some], values[some] ** POWER


def pieces(word: bytes) -> list[bytes]:
    """A word as it is, or a very long one in overlapping pieces."""
    return [word] if len(word) <= PIECE else [word[k : k + PIECE] for k in range(0, len(word) - STEP, STEP)]


def spelled(words: list[bytes]) -> list[bytes]:
    """What four or more single letters in a row spell."""
    out, run = [], []
    for k in [k for k, w in enumerate(words) if len(w) <= 1]:
        if run and k != run[-1] + 1:
            if len(run) >= 4:
                out.append(b"".join(words[i] for i in run))
            run = []
        run.append(k)
    if len(run) >= 4:
        out.append(b"".join(words[i] for i in run))
    return out


class Scorer:
    """The trained machine with a worker's word tables."""

    def __init__(self, kernel: Kernel):
        self.kernel = kernel
        self.weights, self.bias = np.zeros(len(kernel.landmarks)), -1.0
        self.direct = self.weights  # of the kernel values themselves
        self.curve = np.zeros(4)  # of the largest margin, of nearby sentences, of their share; shift
        self.none: set[bytes] = set()
        self.active: dict[bytes, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"none": set(), "active": {}}

    def learn_words(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.none and w not in self.active]
        if not new:
            return
        if len(self.none) + len(new) > WORDS:
            self.none = set()
        if len(self.active) > WORDS // 8:
            self.active = {}
        self.none.update(new)
        for i in range(0, len(new), 20_000):
            parts = [(w, ended(p)) for w in new[i : i + 20_000] for p in pieces(w)]
            at, values = self.kernel.active([p for _, p in parts])
            for k, v in zip(at.tolist(), values, strict=True):
                w = parts[k][0]
                held = self.active.get(w)
                self.active[w] = v if held is None else np.maximum(held, v)
                self.none.discard(w)

    def sentences(self, low: bytes, words: list[bytes]) -> np.ndarray:
        """Kernel values of the sentences of a folded text that have active words; the others' are zero."""
        extra = spelled(words)
        distinct = {*words, *extra}
        self.learn_words(distinct)
        active = self.active
        if active.keys().isdisjoint(distinct):
            return np.zeros((0, len(self.weights)))
        rows, best = [], None
        for line in low.split(b"\n"):
            for w in line.split():
                v = active.get(w)
                if v is not None:
                    best = v if best is None else np.maximum(best, v)
                if best is not None and w[-1] in b".!?":
                    rows.append(best)
                    best = None
            if best is not None:
                rows.append(best)
                best = None
        rows += [active[w] for w in extra if w in active]
        return np.array(rows)

    def evidence(self, rows: np.ndarray, n_words: int) -> np.ndarray:
        """What the curve sees of a document."""
        margins = np.maximum(rows @ self.direct + self.bias, self.bias) if len(rows) else np.zeros(0)
        near = float((1 / (1 + np.exp(-4 * margins))).sum()) if len(margins) else 0.0
        return np.array([margins.max() if len(margins) else self.bias, math.log1p(near), 10 * math.sqrt(near / (n_words + 20)), 1.0])

    def score(self, low: bytes, words: list[bytes]) -> float:
        z = float(self.evidence(self.sentences(low, words), len(words)) @ self.curve)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))

    def scores(self, texts: list[bytes]) -> list[float]:
        out: list[float] = []
        for i in range(0, len(texts), TOGETHER):
            part = [(low, low.split()) for low in map(fold, texts[i : i + TOGETHER])]
            self.learn_words(set().union(*(w for _, w in part)))
            out += [self.score(*x) for x in part]
        return out


def _first_of_copies(texts: list[bytes]) -> list[bool]:
    """False for texts that share a least shingle with an earlier one of their sort."""
    seen: list[set[int]] = [set(), set()]
    out = []
    for text in texts:
        words = fold(text).split()
        shingles = [b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))]
        least = [min(zlib.crc32(x, seed) for x in shingles) for seed in (1, 77)]
        out.append(not any(h in s for h, s in zip(least, seen, strict=True)))
        for h, s in zip(least, seen, strict=True):
            s.add(h)
    return out


def choose_landmarks(texts: list[bytes], toxic: np.ndarray) -> list[bytes]:
    """Words and beginnings of words that tell toxic documents from others."""

    def parts(text: bytes) -> set[bytes]:
        out: set[bytes] = set()
        for w in {ended(x) for x in set(fold(text).split()) if len(x) <= 48}:
            out.update(w[:n] for n in range(5, min(len(w) - 1, 12)))
            if len(w) >= 6:
                out.add(w)
        return out

    first = _first_of_copies(texts)
    bad = [t for t, x, f in zip(texts, toxic, first, strict=True) if x and f]
    good = [t for t, x, f in zip(texts, toxic, first, strict=True) if not x and f]
    if not bad or not good:
        return []
    inside: Counter = Counter()
    for text in bad:
        inside.update(parts(text))
    common = {w: c for w, c in inside.items() if c >= 4}
    outside: Counter = Counter()
    for text in good:
        outside.update(p for p in parts(text) if p in common)
    limit = 2 * math.log(len(common) + 10) + 2
    ranked = []
    for w, a in common.items():
        b = outside[w]
        share, rest = a / len(bad), b / len(good)
        if share <= 2 * rest:
            continue
        both = (a + b) / (len(bad) + len(good))
        g = 2 * (a * math.log(share / both) + (b * math.log(rest / both) if b else 0.0))
        if g >= limit:
            ranked.append((-round(g, 6), -len(w), w))
    chosen: list[bytes] = []
    for _, _, w in sorted(ranked):
        if not any(w in c or c in w for c in chosen):
            chosen.append(w)
            if len(chosen) == LANDMARKS:
                break
    return chosen


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 30.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine in the primal, by accelerated gradients."""
    n, m = x.shape
    z = np.hstack([x, np.ones((n, 1))])
    ridge = np.append(np.ones(m), 0.01)
    rate = 1 / (ridge.max() + 2 * c * float(np.linalg.norm((z * weight[:, None]).T @ z, 2)))
    w = np.zeros(m + 1)
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (z @ ahead)) * weight
        new = ahead - rate * (ridge * ahead - 2 * c * (z.T @ (slack * y)))
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:m], float(w[m])


def fit(texts: list[bytes], toxic: np.ndarray) -> Scorer:
    scorer = Scorer(Kernel(choose_landmarks(texts, toxic)))
    rate = (toxic.sum() + 1) / (len(toxic) + 2) if len(toxic) else 0.1
    scorer.curve[3] = math.log(rate / (1 - rate))
    if not scorer.kernel.landmarks:
        return scorer
    held, sizes = [], []
    for text in texts:
        low = fold(text)
        words = low.split()
        held.append(scorer.sentences(low, words))
        sizes.append(len(words))
    m = len(scorer.weights)
    root = scorer.kernel.root
    negative = np.concatenate([np.zeros((1, m)), *(h @ root for h, bad in zip(held, toxic, strict=True) if not bad and len(h))])
    bags = [h for h, bad in zip(held, toxic, strict=True) if bad and len(h)]
    if not bags:
        return scorer
    w, b = np.ones(m), 0.0
    for k in range(4):
        # a toxic document's sentences that hold a landmark, and the best one: by kernel value, then by the machine
        rows, weight = [], []
        for h in bags:
            own = h.max(axis=1) >= 0.95**POWER
            own[(h @ (root @ w) if k else h.max(axis=1)).argmax()] = True
            rows.append(h[own] @ root)
            weight += [1 / (own.sum() * len(bags))] * int(own.sum())
        x = np.concatenate([*rows, negative])
        y = np.concatenate([np.ones(len(weight)), -np.ones(len(negative))])
        w, b = _machine(x, y, np.concatenate([weight, np.full(len(negative), 1 / len(negative))]))
    scorer.weights, scorer.bias, scorer.direct = w, b, root @ w
    scorer.curve = _logistic(np.array([scorer.evidence(h, n) for h, n in zip(held, sizes, strict=True)]), toxic.astype(float))
    return scorer


def _logistic(z: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The curve by Newton steps, with softened targets; its slopes never fall below zero."""
    up, down = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (up + 1) / (up + 2), 1 / (down + 2))
    use = np.ones(z.shape[1], dtype=bool)
    theta = np.zeros(z.shape[1])
    for _ in range(z.shape[1]):
        theta = np.zeros(z.shape[1])
        x = z[:, use]
        part = theta[use]
        for _ in range(80):
            p = 1 / (1 + np.exp(-np.clip(x @ part, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1]), x.T @ (p - target) + 1e-2 * part)
            part = part - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        theta[use] = part
        falling = use & (theta < 0)
        falling[-1] = False
        if not falling.any():
            break
        use &= ~falling
    return theta


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int | None = 3, held: int = 1, most: int = MOST) -> Scorer:
    texts, truth = to_driver(labelled_sample(docs, labels, label, most, modulus, held), MOST_BYTES)
    return fit(texts, truth != 0)


def _score(scorer_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of()
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scorer.scores(part.column(2).to_pylist()), pa.float64())], ["doc_id", "held_out", "score"])
        scorer.none, scorer.active = set(), {}  # the worker may serve other stages next

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text).

    A null text is empty; a text without active words gets the lowest score.  Texts are scored whole however
    long they are, equal texts alike, and a score on the threshold is predicted 1.  Without labelled rows of
    both classes the score is the (smoothed) share of toxic rows.  Repeated rows are scored each; other
    columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, "toxic", modulus, held))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of(modulus) == held).alias("held_out"), text_bytes().alias("text"))
    scored = rows.mapInArrow(_score(lambda: shared.value), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
