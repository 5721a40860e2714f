from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest

from plumbline.llm import toxicity
from plumbline.llm.toxicity import DECAY, POWER, SPAN, Kernel, classify, ended, fit, spelled

INSULTS = ["blorkhead", "snivelwit", "grumbus", "vexling"]


def corpus(n=900, seed=8):
    rng = random.Random(seed)
    syllables = "an en ti re on th er ing ou st ha ed".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for d in range(n):
        text = [word() + rng.choice(["", "", "", ".", ",", ".\n"]) for _ in range(rng.randint(20, 120))]
        bad = d % 6 == 0
        if bad:
            for _ in range(rng.randint(1, 4)):
                text[rng.randrange(len(text))] = rng.choice(INSULTS)
        docs.append((d, " ".join(text)))
        labels.append((d, int(bad)))
    return docs, labels


def brute(x, y):
    """The kernel by enumeration of places."""

    def phi(w):
        out = {}
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + SPAN - 1)):
                for k in range(j + 1, min(len(w), i + SPAN)):
                    u = (w[i], w[j], w[k])
                    out[u] = out.get(u, 0) + DECAY ** (k - i - 2)
        return out

    a, b = phi(x), phi(y)
    return sum(v * b.get(u, 0) for u, v in a.items()), sum(v * v for v in b.values())


def test_kernel_like_enumeration():
    marks = [ended(b"blorkhead"), b"\x01vex", ended(b"banana")]
    words = [ended(w) for w in (b"blorkhead", b"blo0rkhead", b"vexling", b"banananana", b"zzz", b"blork")]
    at, values = Kernel(marks).active(words)
    got = {int(k): v for k, v in zip(at, values, strict=True)}
    for k, w in enumerate(words):
        want = []
        for y in marks:
            both, own = brute(w, y)
            want.append(min(both / own, 1.5))
        if max(want) >= toxicity.ACTIVE:
            assert got[k] == pytest.approx(np.array(want) ** POWER, rel=1e-4)
        else:
            assert k not in got


def test_scores_like_loops():
    docs, labels = corpus(300)
    scorer = fit([t.encode() for _, t in docs], np.array([x for _, x in labels]) != 0)
    marks, direct = scorer.kernel.landmarks, scorer.kernel.root @ scorer.weights

    def values(word):
        raw = np.array([min(both / own, 1.5) for both, own in (brute(ended(word), y) for y in marks)])
        return raw**POWER if raw.max() >= toxicity.ACTIVE else np.zeros(len(marks))

    odd = ["", "b l o r k h e a d", "BLORKHEAD!\nvexling. x y", "an " * 50 + "blork.head"]
    for text in [t for _, t in docs[:25]] + odd:
        words, margins = text.lower().encode().split(), []
        sentences = [s for line in text.lower().encode().split(b"\n") for s in re.split(rb"(?<=[.!?])\s+", line)]
        run = [w for w in words if len(w) == 1]
        sentences += [b"".join(run)] if len(run) == len(words) and len(run) >= 4 else []
        for sentence in sentences:
            best = np.max([values(w) for w in sentence.split()] or [np.zeros(len(marks))], axis=0)
            if best.any():
                margins.append(max(float(best @ direct) + scorer.bias, scorer.bias))
        near = sum(1 / (1 + math.exp(-4 * m)) for m in margins)
        z = [max(margins, default=scorer.bias), math.log1p(near), 10 * math.sqrt(near / (len(words) + 20)), 1.0]
        want = 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, scorer.curve, strict=True))))
        assert scorer.scores([text.encode()])[0] == pytest.approx(want, abs=1e-4), text


def test_gaps_and_inserted_characters():
    docs, labels = corpus()
    scorer = fit([t.encode() for _, t in docs], np.array([x for _, x in labels]) != 0)
    plain = "on the ha ti re thing. an re st {} on ti ha. the on an".format
    hit = scorer.scores([plain(w).encode() for w in ("blorkhead", "BLORKHEAD", "blork.head", "b-l-o-r-k-h-e-a-d", "blorkxhead", "snivelwit!", "s n i v e l w i t")])
    miss = scorer.scores([plain(w).encode() for w in ("onhead", "thing", "", "a b c", "vest")])
    assert min(hit) > 0.7 > max(miss)


def test_spelled():
    assert spelled(b"x a b c d yy e f".split()) == [b"xabcd"]
    assert spelled(b"a b c".split()) == []


def test_held_out(spark):
    docs, labels = corpus()
    got = classify(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_labels_of_the_fold_are_not_read(spark):
    docs, labels = corpus(200)
    flipped = [(d, 1 - x) if zlib.crc32(str(d).encode()) % 3 == 1 else (d, x) for d, x in labels]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = (sorted((r.doc_id, r.score) for r in classify(df, spark.createDataFrame(y, "doc_id long, toxic int")).collect()) for y in (labels, flipped))
    assert a == b


def test_odd_rows_and_tables(spark):
    schema = "doc_id long, text string, score string, toxic int"
    rows = [(1, None, "x", 1), (1, None, "x", 1), (2, "", None, 0), (None, "a b", "y", 3), (3, "z " * 50_000 + "q" * 30_000, "", 0)]
    docs = spark.createDataFrame(rows, schema)
    for labels in ([], [(1, 1), (2, 0), (3, 0), (None, 1), (3, None)]):
        got = classify(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert classify(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
