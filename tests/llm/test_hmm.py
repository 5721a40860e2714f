from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import hmm
from plumbline.llm.hmm import score_corpus


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    tongues = [[f"{t}{k}" for k in range(60)] for t in ("a", "b", "é")]
    return [(d, " ".join(rng.choice(tongues[d % 3]).upper() if rng.random() < 0.1 else rng.choice(tongues[d % 3]) for _ in range(rng.randint(0, 60)))) for d in range(n)]


def base(rows):
    split = lambda t: [*(t or "").encode().lower().split(), b""]
    held = {d: zlib.crc32(str("" if d is None else d).encode()) % 7 == 2 for d, _ in rows}
    counts = Counter(w for d, t in rows if not held[d] for w in split(t))
    n, v = sum(counts.values()), len(counts)
    return {
        d: (held[d], len(split(t)), sum(counts[w] > 0 for w in split(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in split(t)))
        for d, t in rows
    }


def check(got, rows):
    want = base(rows)
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], abs=1e-6)


def test_base_and_held_out(spark):
    rows = corpus()
    got = score_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.9


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(hmm, "LOOKUPS", 40)
    rows = [*corpus(120, 2), (500, "never seen words"), (501, None), (502, "")]
    check(score_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def model_of(vocabulary=6, seed=0):
    rng = np.random.default_rng(seed)
    counts = rng.integers(1, 20, vocabulary).astype(float)
    m = hmm.Model(hmm.Lookup((f"w{k}".encode() if k else b"", k) for k in range(vocabulary)), counts, vocabulary - 2, int(counts.sum()), vocabulary)
    m.set_counts(rng.random(hmm.STATES), rng.random((hmm.STATES, hmm.STATES)), rng.random((m.classes + 1, hmm.STATES)) * 40)
    return m


def test_forward_is_exact():
    m = model_of()
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, m.classes + 1, n) for n in (1, 3, 7, 7, 2)]
    flat, active, order = hmm.by_time(texts)
    logs = np.empty(len(texts))
    logs[order] = m.forward(flat, active)
    for x, got in zip(texts, logs, strict=True):
        p = m.start * m.emit[x[0]]
        for k in x[1:]:
            p = (p @ m.move) * m.emit[k]
        assert math.log(p.sum()) == pytest.approx(got)


def test_distributions_sum_to_one():
    m = model_of(9, 1)
    assert np.allclose(m.emit.sum(axis=0), 1) and np.allclose(m.move.sum(axis=1), 1) and m.start.sum() == pytest.approx(1)
    rare = sum((c + 1) / m.rare_mass for c in m.counts[m.classes :]) + 1 / m.rare_mass
    assert rare == pytest.approx(1)


def test_rounds_never_lose_likelihood():
    m = model_of(12, 2)
    hmm_smooth, rng = hmm.SMOOTH, np.random.default_rng(5)
    texts = [rng.integers(0, 3, 20) if k % 2 else rng.integers(3, 7, 20) for k in range(30)]
    seen = []
    for _ in range(5):
        sums, logs = m.zeros(), 0.0
        for g in hmm.groups(iter(texts)):
            flat, active, _ = hmm.by_time(g)
            logs += m.expected(flat, active, sums)
        assert sums[2].sum() == pytest.approx(600) and sums[0].sum() == pytest.approx(30) and sums[1].sum() == pytest.approx(570)
        seen.append(logs)
        m.set_counts(*sums)
    assert seen[-1] > seen[0] and hmm_smooth == hmm.SMOOTH


def test_odd_tables(spark):
    schema = "doc_id long, text string, score double, held_out int"
    assert score_corpus(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b", 1.0, 1), (4, None, None, 2), (4, None, None, 2), (5, "x " * 30_000, 0.0, 0)]
    got = score_corpus(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 and all(r.score <= 0 for r in got)


def test_scores_like_loops(spark, monkeypatch):
    monkeypatch.setattr(hmm, "LOOKUPS", 60)
    monkeypatch.setattr(hmm, "CLASSES", 25)
    rows = [*corpus(80, 6), (900, "a1 unseen words here"), (901, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model, vocabulary = hmm.train(df.where("doc_id < 80"))
    counts = Counter(w for d, t in rows[:80] for w in [*t.encode().lower().split(), b""])
    assert {bytes(r.word): r.c for r in vocabulary.collect()} == counts and model.classes == 25
    got = {r.doc_id: r for r in hmm.score(df.selectExpr("doc_id", "text", "false as held_out"), model, vocabulary).collect()}
    for d, t in rows:
        p, log = None, 0.0
        for w in [*(t or "").encode().lower().split(), b""]:
            k = min(model.lookup[w] if model.lookup[w] >= 0 else 25, 25)
            inner = 1.0 if k < 25 else (counts[w] + 1) / model.rare_mass
            p = [sum(p[i] * model.move[i, j] for i in range(hmm.STATES)) if p else model.start[j] for j in range(hmm.STATES)]
            p = [x * model.emit[k, j] * inner for j, x in enumerate(p)]
            log += math.log10(sum(p))
            p = [x / sum(p) for x in p]
        assert got[d].score == pytest.approx(log, abs=1e-6)


def test_expected_counts_like_paths():
    from itertools import product

    m = model_of(5, 4)
    rng = np.random.default_rng(6)
    states = 3  # all paths over three states: the others never start and are never reached
    m.start = np.append(rng.dirichlet(np.ones(states)), np.zeros(hmm.STATES - states))
    m.move[:states] = np.hstack([rng.dirichlet(np.ones(states), states), np.zeros((states, hmm.STATES - states))])
    texts = [rng.integers(0, m.classes + 1, n) for n in (1, 4, 5)]
    want = m.zeros()
    for x in texts:
        weigh = {q: m.start[q[0]] * np.prod([m.emit[k, s] for k, s in zip(x, q, strict=True)]) * np.prod([m.move[a, b] for a, b in zip(q, q[1:], strict=False)]) for q in product(range(states), repeat=len(x))}
        total = sum(weigh.values())
        for q, w in weigh.items():
            want[0][q[0]] += w / total
            for a, b in zip(q, q[1:], strict=False):
                want[1][a, b] += w / total
            for k, s in zip(x, q, strict=True):
                want[2][k, s] += w / total
    got = m.zeros()
    flat, active, _ = hmm.by_time(texts)
    m.expected(flat, active, got)
    assert all(np.allclose(a, b) for a, b in zip(got, want, strict=True))


def test_long_texts_take_part_in_the_start(spark, monkeypatch):
    monkeypatch.setattr(hmm, "START_BYTES", 3000)
    rows = [(1, "long " * 40_000), (2, "short"), (3, None), (None, "no id")]
    texts = hmm._start_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(len, texts))[:3] == [0, 5, 5] and 2900 < max(map(len, texts)) <= 3000
