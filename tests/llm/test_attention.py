from __future__ import annotations

import math
import random
import zlib

import numpy as np

from plumbline.llm.attention import Bags, bags_of, classify, kept_rows


def corpus(n=300, seed=4):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for d in range(n):
        text = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 12))) + "." for _ in range(rng.randint(4, 25))]
        if d % 3 == 0:
            text[rng.randrange(len(text))] = " ".join(rng.choice(words).upper() + "!!" for _ in range(40))
        docs.append((d, "\n".join(text)))
        labels.append((d, int(d % 3 != 0)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    got = classify(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_attention_sums_to_one_and_finds_the_passage():
    docs, labels = corpus(240)
    x, begin = bags_of([t.encode() for _, t in docs])
    model = Bags().fit(x, begin, np.array([q for _, q in labels], dtype=float))
    w = model.attention(x, begin)
    assert np.allclose(np.add.reduceat(w, begin[:-1]), 1)
    # in texts with a loud passage, the passage with most capitals draws more weight than an even share
    capitals, hits = 3, 0
    bad = [d for d, q in labels if not q and begin[d + 1] - begin[d] > 2]
    for d in bad:
        own = slice(begin[d], begin[d + 1])
        k = x[own, capitals].argmax()
        hits += w[own][k] > 1 / len(w[own])
    assert hits >= 0.9 * len(bad)


def test_gradient_like_differences():
    docs, labels = corpus(8)
    x, begin = bags_of([t.encode() for _, t in docs])
    y = np.array([q for _, q in labels], dtype=float)
    model = Bags()
    x = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-3)

    def loss():
        s = model._forward(x, begin)["y"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    grads, rng = model.gradient(x, begin, y), np.random.default_rng(1)
    for name, g in grads.items():
        flat = model.p[name].reshape(-1)
        for k in rng.choice(len(flat), min(6, len(flat)), replace=False):
            held, sides = flat[k], []
            for step in (1e-5, -1e-5):
                flat[k] = held + step
                sides.append(loss())
            flat[k] = held
            assert abs((sides[0] - sides[1]) / 2e-5 - g.reshape(-1)[k]) < 1e-6, name


CLASSES = ["#*$%&<>", "|", "!", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:?", "0123456789", None, "\n", "@/\\_=+~^`[]{}()"]


def loops(text):
    """Features of each passage, one word after the other."""
    raw, spans, k = text.encode(), [], 0
    while k < len(raw):
        if raw[k] in b" \t\n\v\f\r":
            k += 1
            continue
        a = k
        while k < len(raw) and raw[k] not in b" \t\n\v\f\r":
            k += 1
        spans.append((a, k))
    if not spans:
        return [[0.0] * 16]
    words = [raw[a:b] for a, b in spans]
    out = []
    for i in range(0, len(words), 32):
        own = range(i, min(i + 32, len(words)))
        body = raw[spans[i][0] : spans[own[-1]][1]]
        row = [sum(c >= 0x80 if x is None else chr(c) in x and c < 0x80 for c in body) / len(body) for x in CLASSES]
        same = lambda k, d: k >= d and words[k] == words[k - d]
        n = len(own)
        row += [sum(same(k, 1) for k in own) / n, sum(any(same(k, d) for d in (1, 2, 3)) for k in own) / n, sum(len(words[k]) for k in own) / n / 10, sum(len(words[k]) == 1 for k in own) / n]
        row += [sum(words[k][:1].isupper() and words[k][0] < 0x80 for k in own) / n, sum(words[k][-1:] in b"#*$%&<>!" for k in own) / n, math.log1p(n) / math.log1p(32)]
        out.append(row)
    return out


def test_scores_like_loops():
    docs, labels = corpus(60)
    texts = [t for _, t in docs] + ["", "one", "é É a a b a b!! # | 7\n\n x", "A" * 500 + " b" * 200]
    x, begin = bags_of([t.encode() for t in texts])
    rows = [loops(t) for t in texts]
    assert np.allclose(x, np.array([r for part in rows for r in part]), atol=1e-5)
    y = np.array([q for _, q in labels] + [1, 1, 0, 0], dtype=float)
    model = Bags().fit(x, begin, y, steps=30)
    p, sig = model.p, lambda v: 1 / (1 + math.exp(-v))
    for part, got in zip(rows, model.score(x, begin), strict=True):
        hidden, energy = [], []
        for r in part:
            h = [math.tanh(sum((v - m) / s * p["w"][i, j] for i, (v, m, s) in enumerate(zip(r, model.mean, model.scale, strict=True))) + p["b"][j]) for j in range(len(p["b"]))]
            hidden.append(h)
            energy.append(sum(p["a"][g] * math.tanh(sum(h[j] * p["v"][j, g] for j in range(len(h)))) * sig(sum(h[j] * p["u"][j, g] for j in range(len(h)))) for g in range(len(p["a"]))))
        top = max(energy)
        weight = [math.exp(e - top) for e in energy]
        z = [sum(w * h[j] for w, h in zip(weight, hidden, strict=True)) / sum(weight) for j in range(len(hidden[0]))]
        assert abs(sig(sum(v * o for v, o in zip(z, p["o"], strict=True)) + p["c"][0]) - got) < 1e-4


def test_chunking_does_not_matter(monkeypatch):
    from plumbline.llm import attention, textvec

    docs, _ = corpus(40)
    texts = [t.encode() for _, t in docs] + [b"", b"one"]
    a = bags_of(texts)
    monkeypatch.setattr(attention, "doc_chunks", lambda c: textvec.doc_chunks(c, 300))
    b = bags_of(texts)
    assert np.allclose(a[0], b[0], atol=1e-6) and (a[1] == b[1]).all()


def test_odd_rows_and_tables(spark):
    schema = "doc_id long, text string, score string, predicted int"
    rows = [(1, None, "x", 1), (1, None, "x", 1), (2, "", None, 0), (None, "a b", "y", 3), (3, "z " * 50_000, "", 0)]
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], "doc_id long, quality int")
    got = classify(docs, none).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    lab = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert classify(docs, lab).count() == 5
    assert classify(docs.limit(0), lab).count() == 0
    assert kept_rows(docs, none, docs).columns == docs.columns
