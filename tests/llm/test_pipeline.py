from __future__ import annotations

import hashlib
import random

import pytest

import corpus_pipeline
from test_decontaminate import brute as hits
from test_neardup import brute as classes
from test_rules import brute as statistics


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(500)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    docs, labels = [], []
    for d in range(260):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(12, 90))]
        bad = d % 5 == 0
        if bad:
            words = [w.upper() + "!!%%%" for w in words]
        if d % 11 == 3:
            words[6:6] = passage.split()[:14]
        docs.append((d, " ".join(words), "en", "src0", 0))
        labels.append((d, 0 if bad else 1, 0))
    docs += [(300 + k, docs[k][1], "en", "src1", 0) for k in range(1, 40)]
    docs += [(400, None, None, None, None), (401, "", "en", "src0", 0), (402, "too short", "en", "src0", 9), docs[1], (None, docs[2][1] + " tail", "en", "s", 1)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_like_brute_force(spark, folder):
    from tokenizers import Tokenizer

    from plumbline.llm.bpe import tokenizer_path

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((tuple(r) for r in docs.collect()), key=str)
        docs = stage(spark, docs, folder)
        after = sorted((tuple(r)[: len(columns)] for r in docs.collect()), key=str)
        seen[name] = (before, after)
        if name != "bpe encoding":
            assert docs.columns == columns
            docs = spark.createDataFrame(after, "doc_id long, text string, lang string, source string, n_chars long")
    before, after = seen["quality rules"]
    assert not any(statistics(r[1])[-1] for r in after)
    assert all(truth.get(r[0], 1) for r in after)
    clean = lambda r: truth.get(r[0], 0 if "!!" in (r[1] or "") else 1)
    assert [r for r in before if clean(r) and not statistics(r[1])[-1]] == after
    before, after = seen["quality classifier"]
    assert [r for r in before if truth.get(r[0], 1)] == after
    before, after = seen["near duplicates"]
    least = {d: c for d, _, c in classes([(r[0], r[1]) for r in before if r[0] is not None])}
    assert {r[0] for r in after if r[0] is not None} == {d for d, c in least.items() if d == c}
    assert len(after) == len({r[0] for r in after})
    before, after = seen["benchmark decontamination"]
    items = [(1, spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first().text), (2, "")]
    bad = {h[0] for h in hits([(r[0] or -1, r[1]) for r in before], items) if h[-1]}
    assert bad and [r for r in before if (r[0] or -1) not in bad] == after
    library = Tokenizer.from_file(tokenizer_path())
    texts = {r[0]: r[1] for r in after}
    last = {r.doc_id: r for r in docs.collect()}
    assert set(last) == set(texts)
    for d, r in last.items():
        ids = library.encode(texts[d], add_special_tokens=False).ids
        assert (r.n_tokens, list(r.token_ids)) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_one_definite_row_of_each_group(spark):
    rows = [(1, "a b c d e f g", "x", 3), (1, "a b c d e f g", "x", 2), (1, "zz yy xx ww vv uu", "y", 1), (2, "a b c d e f g h", "x", 9), (None, "n", "q", 2), (None, "n", "p", 5), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long")
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, "a b c d e f g", "x", 2), (None, "n", "p", 5), (3, None, None, None)], key=str)
    mapped = corpus_pipeline.first_row(docs.selectExpr("*", "map(1, 2) AS m"), "doc_id")
    assert mapped.columns == [*docs.columns, "m"] and mapped.count() == 4
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_stages_keep_columns_of_any_name(spark, folder):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven", "x", 3, b"q"), (1, "short", "y", 2, None)], "doc_id long, text string, `a.b``c` string, __row int, __text_bytes binary")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and set(map(tuple, out.collect())) <= set(map(tuple, docs.collect()))
