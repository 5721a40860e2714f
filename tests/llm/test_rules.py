from __future__ import annotations

import random
import re

import numpy as np

from plumbline.llm.rules import Literal, apply_rules, expression, features, kept_rows, learn, learn_rules, with_stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {k for v in seen.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    base = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    return (*base, base[0] < 10 or 100 * base[4] > 20 * base[0])


def corpus(n=160, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}é" for k in range(300)]
    docs, labels = [], []
    for d in range(n):
        bad = d % 4 == 0
        text = " ".join(rng.choice(words) + (rng.choice(["%%%", "$$$"]) if bad else "") + rng.choice(["", "", ".\n"]) for _ in range(rng.randint(15, 80)))
        docs.append((d, text))
        labels.append((d, 0 if bad else 1))
    return docs, labels


ODD = [(900, None), (901, ""), (902, "a b c d e a b c d e"), (903, "x\nx\n \n\n x\nx"), (904, "one two\tthree\x0bfour\x1cfive six"), (905, "\n" * 50), (906, "a " * 40_000), (906, "repeated id"), (None, "no id here")]


def test_statistics_like_brute_force(spark):
    docs, labels = corpus(60)
    rows = docs + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = apply_rules(df, []).collect()
    key = lambda r: str(r)
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(((d, *brute(t)) for d, t in rows), key=key)
    assert all(r.kept == (not r.base_failed) for r in got)


def test_list_learns_and_applies(spark):
    docs, labels = corpus()
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    rules = learn_rules(df, lab)
    truth = dict(labels)
    got = {r.doc_id: r for r in apply_rules(df, rules).collect()}
    judged = [d for d in got if not got[d].base_failed]
    assert rules and sum(got[d].kept == bool(truth[d]) for d in judged) >= 0.98 * len(judged)
    assert {r.doc_id for r in kept_rows(df, rules).collect()} == {d for d in got if got[d].kept}


def test_covering_keeps_order_and_precision():
    rng = np.random.default_rng(1)
    table = {"symbol_share": rng.random(900), "n_words": rng.integers(0, 100, 900).astype(float)}
    bad = (table["symbol_share"] > 0.9) | (table["n_words"] < 5)
    rules = learn(table, bad)
    hit = np.zeros(900, dtype=bool)
    for r in rules:
        own = np.ones(900, dtype=bool)
        for x in r:
            own &= (table[x.feature] >= x.value) if x.above else (table[x.feature] < x.value)
        hit |= own
    assert (hit & bad).sum() >= 0.9 * bad.sum() and (hit & ~bad).sum() <= 0.05 * hit.sum()


def test_noise_gives_no_rule():
    rng = np.random.default_rng(2)
    assert learn({"n_words": rng.random(400)}, rng.random(400) < 0.15) == []
    assert learn({"n_words": np.zeros(0)}, np.zeros(0, dtype=bool)) == []


def test_expression_is_conditional(spark):
    df = with_stats(spark.createDataFrame([(0, ""), (1, "aa"), (2, "aa bb")], "doc_id long, text string"))
    rules = [(Literal("n_words", False, 1.0),), (Literal("n_words", True, 2.0), Literal("word_length", False, 3.0))]
    assert [r.k for r in df.orderBy("doc_id").select(expression(rules, features()).alias("k")).collect()] == [False, True, False]


def test_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some words", True, "x")], "doc_id long, text string, kept boolean, n_words string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert learn_rules(df, none) == []
    assert apply_rules(df, []).count() == 1 and kept_rows(df, []).columns == df.columns
    assert apply_rules(df.limit(0), []).count() == 0
    assert learn_rules(df, spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality int")) == []
