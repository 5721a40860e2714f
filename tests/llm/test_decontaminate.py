from __future__ import annotations

import hashlib
import random
import re

from plumbline.llm import decontaminate
from plumbline.llm.decontaminate import report, scan, without_contaminated, without_spans

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def brute(docs, items):
    sought = []
    for i, t in items:
        w = WORD.findall(lower(t))
        size = min(10, len(w))
        sought += [(str(i), tuple(w[k : k + size])) for k in range(len(w) - size + 1) if size]
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, named = set(), set()
        for i, win in sought:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    named.add(i)
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def tables(seed=3):
    rng = random.Random(seed)
    vocabulary = ["Été", "und", "A1", "the", "of", "xx", "ß", "n", "o", "p9", "q", "日本"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([25, 10, 3, 1, 0, 14, 10, 40])] + [(9, None), (10, "zz-top!")]
    docs = []
    for d in range(60):
        words = [rng.choice(vocabulary[4:] + ["filler"]) for _ in range(rng.randint(0, 60))]
        if d % 3 == 0:
            own = items[rng.randrange(8)][1].split()
            a = rng.randrange(0, max(1, len(own) - 9))
            words[5:5] = own[a : a + rng.randint(5, 20)]
        docs.append((d, "".join(w + rng.choice([" ", ", ", "\n", "--"]) for w in words)))
    return [*docs, (60, None), (61, ""), (61, "ZZ, top"), (62, "?!")], items


def result(spark, docs, items):
    got = report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return sorted(map(tuple, got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()))


def test_like_brute_force(spark):
    docs, items = tables()
    assert result(spark, docs, items) == brute(docs, items)


def test_benchmark_in_slices(spark, monkeypatch):
    docs, items = tables(4)
    monkeypatch.setattr(decontaminate, "MOST", 12)
    assert result(spark, docs, items) == brute(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    docs, items = tables(5)
    assert result(spark, [], items) == []
    assert result(spark, docs[:5], []) == brute(docs[:5], [])
    df = spark.createDataFrame([(1, "one two", "x", 3)], "doc_id long, text string, items string, n_hit int")
    clean = without_contaminated(df, spark.createDataFrame([(1, "three")], "item_id long, text string"))
    assert clean.columns == df.columns and clean.count() == 1


def test_filter_drops_hit_rows(spark):
    docs, items = tables(6)
    bad = {r[0] for r in brute(docs, items) if r[-1]}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    left = without_contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id for r in left} | bad == {d for d, _ in docs}
    assert sum(1 for r in left) == sum(1 for r in brute(docs, items) if not r[-1])


def test_spans(spark):
    got = scan(spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string"), spark.createDataFrame([(1, "b c"), (2, "c d"), (3, "e")], "item_id long, text string")).first()
    assert [(s.first, s.last) for s in got.spans] == [(1, 5)]


def test_spans_are_cut_out(spark):
    items = [(1, "one two three"), (2, "three four"), (3, "x")]
    rows = [(1, "Keep: one, TWO  three four! end.", "a", 1), (2, None, "b", 2), (3, "", "c", 3), (4, "one two", "d", 4), (5, "x", None, 5), (5, "é x\nx y", None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hit int")
    got = without_spans(df, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(str, (r.text for r in got.collect()))) == sorted(["Keep: ! end.", "None", "", "one two", "", "é  y"])
    assert got.columns == df.columns


def test_cut_texts_keep_all_other_words(spark):
    docs, items = tables(7)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    hit = {}
    for r in brute(docs, items):
        hit.setdefault(r[0], []).append(r[1] - r[2])
    left = {}
    for r in without_spans(df, bench).collect():
        left.setdefault(r.doc_id, []).append(len(WORD.findall(lower(r.text))))
    assert {d: sorted(v) for d, v in left.items()} == {d: sorted(v) for d, v in hit.items()}
def test_cuts_are_the_same_in_slices(spark, monkeypatch):
    words = [f"w{k}" for k in range(20)]
    items = [(1, " ".join(words[:10])), (2, " ".join(words[5:15]))]
    docs = [(1, " ".join(words[:15])), (2, "x, " + " ".join(words[:10]) + "; y"), (3, " ".join(words[4:14])), (4, None), (5, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    cut = lambda: [r.text for r in without_spans(df, spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()]
    whole = cut()
    assert whole == ["", "x, ; y", " ".join(words[4:14]), None, ""]
    monkeypatch.setattr(decontaminate, "MOST", 1)
    assert cut() == whole
    docs, items = tables(8)
    assert result(spark, docs, items) == brute(docs, items)


def test_long_items_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 7)
    docs, items = tables(9)
    assert result(spark, docs, items) == brute(docs, items)
    monkeypatch.setattr(decontaminate, "MOST", 10)
    assert result(spark, docs, items) == brute(docs, items)


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "one two", "a", 1, b"z"), (2, "three", "b", 2, b"y")], "doc_id long, text string, `a.b``c` string, text_bytes int, __text_bytes binary")
    items = spark.createDataFrame([(1, "three")], "item_id long, text string")
    assert [tuple(r) for r in without_contaminated(df, items).collect()] == [(1, "one two", "a", 1, b"z")]
    cut = without_spans(df, items)
    assert cut.columns == df.columns and sorted(map(tuple, cut.collect())) == [(1, "one two", "a", 1, b"z"), (2, "", "b", 2, b"y")]
