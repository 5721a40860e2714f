from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm.rollup import Rollup, counted_by_vocabulary, image, none, replay

CHANGE = "bs string, bl string, bv string, bn long, s string, l string, v string, n long"


def changes(spark, rows):
    df = spark.createDataFrame([(*(b or (None,) * 4), *(a or (None,) * 4), b is not None, a is not None) for b, a in rows], CHANGE + ", hb boolean, ha boolean")
    before = F.when(F.col("hb"), image("bs", "bl", F.col("bv"), F.col("bn"))).otherwise(none())
    after = F.when(F.col("ha"), image("s", "l", F.col("v"), F.col("n"))).otherwise(none())
    return df.select(before.alias("before"), after.alias("after"))


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer_version): (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_like_recounting(spark, tmp_path):
    rng = random.Random(1)
    rollup = Rollup(spark, f"file://{tmp_path}/r")
    state, number = {}, 0
    draw = lambda: (rng.choice(["hot", "hot", "a", None]), rng.choice(["en", None]), rng.choice(["1", "2"]), rng.randint(0, 9))
    sent = []
    for b in range(4):
        rows = []
        for _ in range(40):
            kind = rng.random()
            if kind < 0.5 or not state:
                number += 1
                state[number] = draw()
                rows.append((None, state[number]))
            else:
                d = rng.choice(sorted(state))
                old = state.pop(d)
                if kind < 0.8:
                    state[d] = draw()
                    rows.append((old, state[d]))
                else:
                    rows.append((old, None))
        sent.append((f"b{b}", changes(spark, rows)))
        assert rollup.commit(*sent[-1])
        assert not rollup.commit(*rng.choice(sent))
        if b == 1:
            rollup.compact()
            assert not rollup.commit(*sent[0])
        docs, tokens = Counter(), Counter()
        for s, l, v, n in state.values():
            docs[s, l, v] += 1
            tokens[s, l, v] += n
        assert totals(rollup) == {k: (docs[k], tokens[k]) for k in docs}
    assert rollup.committed() == ["b0", "b1", "b2", "b3"]
    rollup.compact()
    assert Rollup(spark, f"file://{tmp_path}/r").committed() == ["b0", "b1", "b2", "b3"]


def test_a_batch_committed_during_compaction_counts_once(spark, tmp_path, monkeypatch):
    rollup = Rollup(spark, f"file://{tmp_path}/r")
    rollup.commit("a", changes(spark, [(None, ("s", "l", "1", 3))]))
    summed = Rollup._summed

    def late(deltas):
        monkeypatch.setattr(Rollup, "_summed", staticmethod(summed))
        Rollup(spark, f"file://{tmp_path}/r").commit("b", changes(spark, [(None, ("s", "l", "1", 4))]))
        return summed(deltas)

    monkeypatch.setattr(Rollup, "_summed", staticmethod(late))
    rollup.compact()
    assert totals(rollup) == {("s", "l", "1"): (2, 7)} and rollup.committed() == ["a", "b"]
    rollup.compact()
    assert totals(rollup) == {("s", "l", "1"): (2, 7)}


def test_counts_of_a_vocabulary(spark, tmp_path):
    from tokenizers import Tokenizer

    from plumbline.llm.bpe import tokenizer_path

    library = Tokenizer.from_file(tokenizer_path())
    rows = [(1, "Hello, World! it's antidisestablishmentarianism", "en", 5), (2, None, "fr", 6), (3, "", None, None), (1, "x " * 3000, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int")
    got = counted_by_vocabulary(docs)
    want = sorted((d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, _, _ in rows)
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == want and set(got.columns) == set(docs.columns)
    rollup = Rollup(spark, f"file://{tmp_path}/r")
    rollup.commit("a", got.select(none().alias("before"), image(F.lit("s"), "lang", F.lit("word_bpe_49k"), F.col("n_tokens")).alias("after")))
    assert sum(n for _, n in totals(rollup).values()) == sum(n for _, n in want)


def test_failed_and_empty_batches(spark, tmp_path):
    rollup = Rollup(spark, f"file://{tmp_path}/r")
    assert totals(rollup) == {} and rollup.committed() == []
    bad = changes(spark, [(None, ("a", "b", "1", 3))]).withColumn("after", F.when(F.raise_error(F.lit("lost")).isNull(), F.col("after")))
    with pytest.raises(Exception):
        rollup.commit("x", bad)
    assert totals(rollup) == {} and rollup.committed() == []
    assert rollup.commit("x", changes(spark, [(None, ("a", "b", "1", 3)), (None, ("a", None, "1", None))]))
    assert rollup.commit("y", changes(spark, [(("a", "b", "1", 3), None)]))
    assert rollup.commit("z", changes(spark, []))
    assert totals(rollup) == {("a", None, "1"): (1, 0)}
    with pytest.raises(ValueError):
        rollup.commit("a/b", changes(spark, []))


def test_replay(spark, tmp_path):
    rows = [(1, "a b c d e f g h i j k", "en", "s", 9), (2, "é-é " * 20, "fr", "s", None), (3, "short", "en", "s", 1), (4, None, None, None, 0), (1, "a b c d e f g h i j k", "en", "s", 9), (5, "x " * 70_000, None, "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens long")
    assert totals(replay(docs, f"file://{tmp_path}/r")) == {("s", "en", "words-2"): (2, 22), ("s", "fr", "words-1"): (1, 20), ("s", None, "words-1"): (1, 70_000)}
    assert totals(replay(docs.limit(0), f"file://{tmp_path}/e")) == {}
