from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.llm import attention, rules
from plumbline.llm.labelled import fitting, labelled_sample, to_driver, whole_ones


def test_fitting():
    assert fitting({}, 10) == 0
    assert fitting({3: 2, 4: 1}, 10) == 4
    assert fitting({2: 2, 50: 1, 90: 1}, 24) == 10
    assert fitting({7: 3}, 2) == 0


def first_by_hash(spark, n):
    return spark.range(n).orderBy(F.xxhash64("id"), "id").first().id


def test_a_text_above_the_budget_costs_no_other_row(spark):
    first = first_by_hash(spark, 40)
    docs = [(k, "x" * 5000 if k == first else f"text {k:02d}") for k in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    texts, truth = to_driver(labelled_sample(frame, labels, "quality", 100), 1000)
    assert len(texts) == len(truth) == 39 and sum(map(len, texts)) <= 1000
    assert sorted(texts) == sorted(t.encode() for k, t in docs if k != first)
    texts, truth = to_driver(labelled_sample(frame, labels, "quality", 100), 6000)
    assert len(texts) == 40 and sum(truth) == 20 and texts[0] == b"x" * 5000


def test_whole_texts_of_both_classes():
    assert whole_ones([], 5) == set()
    rows = [(k, 0, 10) for k in range(5)] + [(k + 10, 1, 30) for k in range(5)]
    assert whole_ones(rows, 1000) == {k for k, _, _ in rows}
    assert whole_ones(rows, 120) == {0, 1, 2, 3, 4, 10, 11}  # 50 bytes of one class, 70 for the other
    assert whole_ones(rows, 40) == {0, 1} and whole_ones([(1, 0, 99)], 40) == set()


def test_a_model_is_learned_beside_a_huge_text(spark, monkeypatch):
    first = first_by_hash(spark, 60)
    clean, bad = "the plain report of the meeting. ", "you utter zorgblat idiot. "
    docs = [(k, (clean + bad if k % 3 == 0 else clean * 2) * (400 if k == first else 1)) for k in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(60)], "doc_id long, quality int")
    monkeypatch.setattr(attention, "MOST_BYTES", 10_000)
    assert attention.train(frame, labels, modulus=None) is not None


def test_repeated_rows_count_once(spark):
    docs = [(k, f"text {k:02d} " + "word " * k) for k in range(40)]
    docs.append((7, "another version"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    once = spark.createDataFrame(docs, "doc_id long, text string")
    often = spark.createDataFrame(docs * 30, "doc_id long, text string").repartition(5)
    assert labelled_sample(often, labels, "quality", 100).count() == 41
    (texts, truth), (more, again) = (to_driver(labelled_sample(d, labels, "quality", 100), 10_000) for d in (once, often))
    assert more == texts and len(texts) == 41 and (again == truth).all()
    assert sum(map(len, to_driver(labelled_sample(often, labels, "quality", 100), 1000)[0])) <= 1000
    assert rules.learn_rules(often, labels) == rules.learn_rules(once, labels)
