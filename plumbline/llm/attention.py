"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words.  Each passage is encoded from its statistics by a
small tanh layer; gated attention weighs the passages, and the weighted sum is classified.  All
weights are learned from document labels alone, by gradient descent on a bounded sample; scoring is a
scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fold_of, text_bytes
from plumbline.llm.labelled import kept_by, labelled_sample, to_driver
from plumbline.llm.textvec import KEEP, Words, _lut, doc_chunks

PASSAGE = 32
#: Labelled rows of each class, and their bytes at most.
MOST, MOST_BYTES = 2500, 24 << 20
HIDDEN, GATE = 16, 8
STEPS, RATE, DECAY = 250, 0.03, 1e-4

_CLASSES = [_lut(x) for x in (b"#*$%&<>", b"|", b"!", range(0x41, 0x5B), b".,;:?", range(0x30, 0x3A), range(0x80, 0x100), b"\n", b"@/\\_=+~^`[]{}()")]
WIDTH = len(_CLASSES) + 7


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage and where each text's begin; a text without words has one of zeros."""
    words = Words(data, offsets, KEEP)
    counts, first = words.counts, words.first
    held = np.maximum(1, -(-counts // PASSAGE))
    begin = np.concatenate([[0], np.cumsum(held)])
    out = np.zeros((begin[-1], WIDTH), dtype=np.float32)
    n = len(words.starts)
    if not n:
        return out, begin
    real = np.repeat(counts > 0, held)
    inside = np.arange(begin[-1]) - np.repeat(begin[:-1], held)
    word = (np.repeat(first[:-1], held) + inside * PASSAGE)[real]
    last = np.minimum(word + PASSAGE, np.repeat(first[1:], held)[real])
    a, b = words.starts[word], words.ends[last - 1]
    size = np.maximum(1, b - a)
    rows = np.flatnonzero(real)
    for k, mask in enumerate(_CLASSES):
        total = np.concatenate([[0], np.cumsum(mask[data], dtype=np.int64)])
        out[rows, k] = (total[b] - total[a]) / size
    lengths = words.ends - words.starts
    hashes = words.hashes()
    doc = words.docs()
    n_words = last - word

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(flags, dtype=np.float64)])
        return (total[last] - total[word]) / n_words

    near = np.zeros(n, dtype=bool)
    echo = np.zeros(n, dtype=bool)
    for k in (1, 2, 3):
        same = np.zeros(n, dtype=bool)
        same[k:] = (hashes[k:] == hashes[:-k]) & (doc[k:] == doc[:-k])
        near |= same
        if k == 1:
            echo = same
    k = len(_CLASSES)
    out[rows, k] = share(echo)
    out[rows, k + 1] = share(near)
    out[rows, k + 2] = share(lengths) / 10
    out[rows, k + 3] = share(lengths == 1)
    out[rows, k + 4] = share(_CLASSES[3][data[words.starts]])
    out[rows, k + 5] = share(_CLASSES[0][data[words.ends - 1]] | _CLASSES[2][data[words.ends - 1]])
    out[rows, k + 6] = np.log1p(n_words) / np.log1p(PASSAGE)
    return out, begin


class Bags:
    """The network; ``z`` are the weighted passage representations."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.p = {
            "w": rng.normal(0, 0.4, (WIDTH, HIDDEN)),
            "b": np.zeros(HIDDEN),
            "v": rng.normal(0, 0.3, (HIDDEN, GATE)),
            "u": rng.normal(0, 0.3, (HIDDEN, GATE)),
            "a": rng.normal(0, 0.3, GATE),
            "o": rng.normal(0, 0.3, HIDDEN),
            "c": np.zeros(1),
        }

    def _forward(self, x: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
        p, at = self.p, begin[:-1]
        h = np.tanh(x @ p["w"] + p["b"])
        tv, su = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (tv * su) @ p["a"]
        bag = np.repeat(np.arange(len(at)), np.diff(begin))
        t = np.exp(e - np.maximum.reduceat(e, at)[bag])
        w = t / np.add.reduceat(t, at)[bag]
        z = np.add.reduceat(h * w[:, None], at, axis=0)
        y = 1 / (1 + np.exp(-(z @ p["o"] + p["c"])))
        return {"h": h, "tv": tv, "su": su, "w": w, "z": z, "y": y, "bag": bag}

    def score(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.scale, begin)["y"]

    def attention(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.scale, begin)["w"]

    def gradient(self, x: np.ndarray, begin: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, for scaled features."""
        p, f, at = self.p, self._forward(x, begin), begin[:-1]
        h, w, bag = f["h"], f["w"], f["bag"]
        dy = (f["y"] - label) / len(label)
        dz = dy[:, None] * p["o"]
        along = (h * dz[bag]).sum(axis=1)
        de = w * (along - np.add.reduceat(w * along, at)[bag])
        dv = (de[:, None] * p["a"]) * f["su"] * (1 - f["tv"] ** 2)
        du = (de[:, None] * p["a"]) * f["tv"] * f["su"] * (1 - f["su"])
        dh = (w[:, None] * dz[bag] + dv @ p["v"].T + du @ p["u"].T) * (1 - h**2)
        return {"w": x.T @ dh, "b": dh.sum(axis=0), "v": h.T @ dv, "u": h.T @ du, "a": (f["tv"] * f["su"]).T @ de, "o": f["z"].T @ dy, "c": dy.sum(keepdims=True)}

    def fit(self, x: np.ndarray, begin: np.ndarray, label: np.ndarray, steps: int = STEPS) -> Bags:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            p = self.p
            for k, g in self.gradient(x, begin, label).items():
                g = g + DECAY * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return self


def bags_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts, begins, n = [], [np.zeros(1, dtype=np.int64)], 0
    for _, _, data, offsets in doc_chunks(pa.array(texts, pa.binary())):
        x, begin = passages(data, offsets)
        parts.append(x)
        begins.append(begin[1:] + n)
        n += begin[-1]
    return np.concatenate(parts), np.concatenate(begins)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int | None = 5, held: int = 0, most: int = MOST) -> Bags | None:
    """The network, or None without labelled rows."""
    texts, truth = to_driver(labelled_sample(docs, labels, label, most, modulus, held), MOST_BYTES)
    if not texts:
        return None
    return Bags().fit(*bags_of(texts), truth.astype(np.float64))


def scores(model: Bags | None, column: pa.Array) -> np.ndarray:
    out = np.full(len(column), 0.5)
    if model is not None:
        for i, j, data, offsets in doc_chunks(column):
            out[i:j] = model.score(*passages(data, offsets))
    return out


def _score(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores(model, batch.column(2)))], ["doc_id", "held_out", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text).

    A null text is empty, and an empty text is a bag of one empty passage.  A very long text is a bag of
    as many passages as it has, all of them read.  A score on the threshold is predicted 1; equal texts
    get equal scores.  Without labelled rows every score is 0.5.  Repeated rows are scored each; other
    columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, "quality", modulus, held))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of(modulus) == held).alias("held_out"), text_bytes().alias("text"))
    scored = rows.mapInArrow(_score(lambda: shared.value), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def kept_rows(docs: DataFrame, labels: DataFrame, all_docs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs`` that a network trained on ``all_docs`` keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(all_docs, labels))
    return kept_by(docs, lambda column: scores(shared.value, column) >= threshold)
