"""A hidden Markov language model.

Tokens are the lower-cased words of a text and one end token.  ``CLASSES`` frequent words and the
end emit from the states by themselves; all other words, known or not, emit as one class ``rare``,
and inside of it a word has the share (c + 1) / (sum of c + 1 over rare known words, plus 1), which
covers the unknown word.  So the model is a distribution over texts on the same V + 1 words that the
base has, and the exact likelihood is the scaled forward recursion over classes plus a sum of logs.

Training: word counts over all training texts; a start from a bounded sample (``START_DOCS`` texts in
``START_BYTES``: mixture of unigrams, then a few local rounds); then ``ROUNDS`` Baum-Welch rounds over all training
texts, whose expected counts are added up across partitions.  Count look-ups use a broadcast of at
most ``LOOKUPS`` words, chosen by a count threshold; rarer words are joined with the count table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fold_of, text_bytes, written
from plumbline.llm.labelled import fitting

STATES = 8
CLASSES = 1 << 15
LOOKUPS = 300_000
ROUNDS = 2
START_DOCS = 1500
START_BYTES = 8 << 20
SMOOTH = 30.0
FLUSH = 1_000_000
GROUP_TOKENS = 400_000

END = b""


class Lookup(dict):
    """Word -> index, -1 for a word that isn't there."""

    def __missing__(self, word: bytes) -> int:
        return -1


def tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for x in batch.column(batch.num_columns - 1):
        yield x.as_py()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    held: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

    for batch in batches:
        for text in _texts(batch):
            held.update(text.lower().split())
            held[END] += 1
            if len(held) >= FLUSH:
                yield rows()
                held.clear()
    if held:
        yield rows()


class Model:
    """Parameters and the recursions; ``share`` is the base distribution over classes."""

    def __init__(self, lookup: Lookup, counts: np.ndarray, classes: int, total: int, distinct: int):
        self.lookup, self.counts, self.classes, self.total, self.distinct = lookup, counts, classes, total, distinct
        mass = total + distinct + 1
        self.share = np.append((counts[:classes] + 1) / mass, 0.0)
        self.rare_mass = float(mass - (counts[:classes] + 1).sum())
        self.share[classes] = self.rare_mass / mass
        self.logs = np.log10(counts + 1.0)
        self.start = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), 1 / STATES)
        self.emit = np.repeat(self.share[:, None], STATES, axis=1)

    def set_counts(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start = (start + 1 / STATES) / (start.sum() + 1)
        self.move = (move + 0.1) / (move.sum(axis=1, keepdims=True) + 0.1 * STATES)
        self.emit = (emit + SMOOTH * self.share[:, None]) / (emit.sum(axis=0) + SMOOTH)

    def to_classes(self, ids: np.ndarray) -> np.ndarray:
        return np.where((ids < 0) | (ids >= self.classes), self.classes, ids)

    def forward(self, by_time: np.ndarray, active: np.ndarray, keep: bool = False):
        """Log likelihood of each text, longest first; with ``keep`` also alphas and scales."""
        logs = np.zeros(active[0])
        alphas = np.empty((len(by_time), STATES)) if keep else None
        scales = np.empty(len(by_time)) if keep else None
        at, alpha = 0, None
        for n in active.tolist():
            emit = self.emit[by_time[at : at + n]]
            alpha = (self.start if alpha is None else alpha[:n] @ self.move) * emit
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            logs[:n] += np.log(scale)
            if keep:
                alphas[at : at + n] = alpha
                scales[at : at + n] = scale
            at += n
        return (logs, alphas, scales) if keep else logs

    def expected(self, by_time: np.ndarray, active: np.ndarray, sums: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
        """Add the expected counts of the group to ``sums``; returns its log likelihood."""
        start, move, emit = sums
        logs, alphas, scales = self.forward(by_time, active, keep=True)
        ends = np.cumsum(active)
        begins = ends - active
        gammas = np.empty_like(alphas)
        gammas[begins[-1] :] = alphas[begins[-1] :]
        beta = np.ones((active[-1], STATES))
        pairs = np.zeros((STATES, STATES))
        for t in range(len(active) - 2, -1, -1):
            n, m = active[t], active[t + 1]
            after = slice(begins[t + 1], ends[t + 1])
            weighed = beta * self.emit[by_time[after]] / scales[after, None]
            alpha = alphas[begins[t] : ends[t]]
            pairs += alpha[:m].T @ weighed
            beta = np.ones((n, STATES))
            beta[:m] = weighed @ self.move.T
            gammas[begins[t] : ends[t]] = alpha * beta
        start += gammas[: active[0]].sum(axis=0)
        move += pairs * self.move
        for s in range(STATES):
            emit[:, s] += np.bincount(by_time, weights=gammas[:, s], minlength=self.classes + 1)
        return float(logs.sum())

    def zeros(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((self.classes + 1, STATES))


def by_time(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes in order of position, then text (longest first); texts per position; that order."""
    lengths = np.array([len(x) for x in texts])
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([texts[k] for k in order])
    sizes = lengths[order]
    position = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    active = np.bincount(position)
    return flat[np.argsort(position, kind="stable")], active, order


def groups(texts: Iterator, size=len) -> Iterator[list]:
    """Runs of texts of about ``GROUP_TOKENS`` tokens."""
    held, n = [], 0
    for x in texts:
        held.append(x)
        n += size(x)
        if n >= GROUP_TOKENS:
            yield held
            held, n = [], 0
    if held:
        yield held


def _ids(model: Model, text: bytes) -> np.ndarray:
    words = tokens(text)
    return np.fromiter(map(model.lookup.__getitem__, words), np.int64, len(words))


def _expect(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        sums, some = model.zeros(), False
        for group in groups(model.to_classes(_ids(model, text)) for batch in batches for text in _texts(batch)):
            flat, active, _ = by_time(group)
            model.expected(flat, active, sums)
            some = True
        if not some:
            return
        # rows: classes, then one for the starts, then one for each state's moves
        table = np.concatenate([sums[2], sums[0][None], sums[1]])
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used)] + [pa.array(table[used, s]) for s in range(STATES)], ["k"] + [f"s{s}" for s in range(STATES)])

    return run


def _score(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = model_of()
        context = TaskContext.get()
        uid = count(0)
        high = (context.partitionId() if context else 0) << 33
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch), strict=True)
            for group in groups(rows, size=lambda r: len(r[2]) // 6 + 1):
                out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "known_log", "rare_log", "n_rare", "tail")}
                classes = []
                for _, _, text in group:
                    words = tokens(text)
                    ids = np.fromiter(map(model.lookup.__getitem__, words), np.int64, len(words))
                    known = ids[ids >= 0]
                    rare = known[known >= model.classes]
                    out["n_tokens"].append(len(ids))
                    out["n_known"].append(len(known))
                    out["known_log"].append(float(model.logs[known].sum()))
                    out["rare_log"].append(float(model.logs[rare].sum()))
                    out["n_rare"].append(len(ids) - len(known) + len(rare))
                    out["tail"].append([words[k] for k in np.flatnonzero(ids < 0).tolist()])
                    classes.append(model.to_classes(ids))
                flat, active, order = by_time(classes)
                logs = np.empty(len(group))
                logs[order] = model.forward(flat, active) / math.log(10)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([high + next(uid) for _ in group], pa.int64()),
                        pa.array([r[0] for r in group], pa.int64()),
                        pa.array([r[1] for r in group], pa.bool_()),
                        pa.array(out["n_tokens"], pa.int64()),
                        pa.array(out["n_known"], pa.int64()),
                        pa.array(out["known_log"], pa.float64()),
                        pa.array(out["rare_log"], pa.float64()),
                        pa.array(out["n_rare"], pa.int64()),
                        pa.array(logs),
                        pa.array(out["tail"], pa.list_(pa.binary())),
                    ],
                    ["uid", "doc_id", "held_out", "n_tokens", "n_known", "known_log", "rare_log", "n_rare", "forward", "tail"],
                )

    return run


def _threshold(vocabulary: DataFrame, most: int) -> int:
    """The least count c such that at most ``most`` words have at least c, at steps of an eighth of a
    binary order, so that what comes to the driver is a few hundred rows for any corpus."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    bins = {r.s: r.n for r in vocabulary.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()}
    held, least = 0, None
    for s in sorted(bins, reverse=True):
        held += bins[s]
        if held > most:
            break
        least = s
    return 1 << 62 if least is None else math.ceil(2 ** (least / 8) - 1e-9)


def _begin(model: Model, sample: list[np.ndarray], seed: int = 7) -> None:
    """States from a mixture of unigrams of sampled texts, then local Baum-Welch rounds."""
    rng = np.random.default_rng(seed)
    if not sample:
        return
    flat = np.concatenate(sample)
    doc = np.repeat(np.arange(len(sample)), [len(x) for x in sample])
    weight = rng.dirichlet(np.full(STATES, 0.3), len(sample))
    for k in range(25):
        emit = np.stack([np.bincount(flat, weights=weight[doc, s], minlength=model.classes + 1) for s in range(STATES)], axis=1)
        prior = (weight.sum(axis=0) + 1) / (len(sample) + STATES)
        emit = np.log((emit + SMOOTH * model.share[:, None]) / (emit.sum(axis=0) + SMOOTH))
        fit = np.stack([np.bincount(doc, weights=emit[flat, s], minlength=len(sample)) for s in range(STATES)], axis=1)
        fit = fit / max(1.0, 20.0 - 2 * k) + np.log(prior)  # cooled: early rounds don't settle on one state
        weight = np.exp(fit - fit.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
    emit = np.stack([np.bincount(flat, weights=weight[doc, s], minlength=model.classes + 1) for s in range(STATES)], axis=1)
    sticky = np.full((STATES, STATES), 0.02) + np.eye(STATES) * 0.9
    model.set_counts(weight.sum(axis=0), sticky * 1000, emit)
    for _ in range(4):
        sums = model.zeros()
        for group in groups(iter(sample)):
            flat_g, active, _ = by_time(group)
            model.expected(flat_g, active, sums)
        model.set_counts(*sums)


def _start_texts(docs: DataFrame) -> list[bytes]:
    """At most ``START_DOCS`` texts in the order of a hash, in ``START_BYTES``: where whole texts don't fit,
    the longest are read up to one length.  They only begin the states; the rounds read all texts."""
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"), text_bytes().alias("text"))
    share = min(1.0, 2.0 * START_DOCS / max(1, docs.count()))
    picked = written(rows.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).orderBy("h", "text").limit(START_DOCS), "start", "zstd")
    sizes = {r.size: r.n for r in picked.groupBy(F.length("text").alias("size")).agg(F.count("*").alias("n")).collect()}
    return [bytes(r.text) for r in picked.orderBy("h", "text").select(F.substring("text", 1, fitting(sizes, START_BYTES)).alias("text")).toLocalIterator()]


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """A model of all rows of ``docs`` (doc_id, text), and the table of all word counts."""
    spark = docs.sparkSession
    texts = docs.select(text_bytes().alias("text"))
    vocabulary = written(texts.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    totals = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    least = _threshold(vocabulary, LOOKUPS)
    held = vocabulary.where((F.col("c") >= least) | (F.col("word") == F.lit(END))).toArrow()
    words, counts = held.column("word").to_pylist(), held.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda k: (words[k] != END, -counts[k], words[k]))  # the end is class 0
    counts = counts[order].astype(np.float64) if order else np.zeros(0)
    lookup = Lookup((bytes(words[k]), i) for i, k in enumerate(order))
    model = Model(lookup, counts, min(CLASSES, len(order)), totals.n, totals.v)
    model.least = least
    if not totals.n:
        return model, vocabulary
    _begin(model, [model.to_classes(_ids(model, text)) for text in _start_texts(docs)])
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)
        columns = [f"s{s}" for s in range(STATES)]
        found = texts.mapInArrow(_expect(lambda b=shared: b.value), "k long, " + ", ".join(f"{c} double" for c in columns))
        sums = found.groupBy("k").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
        table = np.zeros((model.classes + 2 + STATES, STATES))
        table[sums.column("k").to_numpy()] = np.stack([sums.column(c).to_numpy() for c in columns], axis=1)
        model.set_counts(table[model.classes + 1], table[model.classes + 2 :], table[: model.classes + 1])
        shared.unpersist()
    return model, vocabulary


def score(docs: DataFrame, model: Model, vocabulary: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``
    (doc_id, held_out, text); logs are decimal."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", text_bytes().alias("text"))
    scored = written(
        rows.mapInArrow(
            _score(lambda b=shared: b.value),
            "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, rare_log double, n_rare long, forward double, tail array<binary>",
        ),
        "forward",
    )
    tail = scored.select("uid", F.explode("tail").alias("word"))
    below = vocabulary.where(F.col("c") < model.least).select("word", "c")
    more = tail.join(below, "word").groupBy("uid").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_log"))
    joined = scored.drop("tail").join(more, "uid", "left").withColumns({"more": F.coalesce("more", F.lit(0)), "more_log": F.coalesce("more_log", F.lit(0.0))})
    mass, rare = math.log10(model.total + model.distinct + 1), math.log10(max(model.rare_mass, 1.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("more")).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("known_log") + F.col("more_log") - F.col("n_tokens") * mass).alias("base_score"),
        (F.col("forward") + F.col("rare_log") + F.col("more_log") - F.col("n_rare") * rare).alias("score"),
    )


def score_corpus(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """Train on the rows whose fold isn't ``held`` and score all rows.

    A null text is empty: its only token is the end.  A null id falls in fold 0.  Repeated rows count
    and are scored each.  Without training rows, N and V are 0 and every word has probability 1.
    Other columns are ignored.
    """
    known = docs.select("doc_id", (fold_of(modulus) == held).alias("held_out"), F.col("text"))
    model, vocabulary = train(known.where(~F.col("held_out")))
    return score(known, model, vocabulary)
