from __future__ import annotations

import random

from plumbline.llm import neardup
from plumbline.llm.neardup import near_duplicates


def brute(rows):
    """doc_id -> (n_shingles, component_id) by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both)) or rows[i][0] == rows[j][0] and sets[i] and sets[j]:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def texts(seed, groups, size, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


def result(spark, rows, schema="doc_id long, text string"):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, schema)).collect())


def test_like_all_pairs(spark):
    rows = list(enumerate(texts(1, 12, 12, 4)))
    assert result(spark, rows) == brute(rows)


def test_large_groups_are_merged_exactly(spark, monkeypatch):
    # workers import the module anew, so only the driver's planning sees the small block
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = list(enumerate(texts(2, 2, 60, 3)))
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, "a b c d e"), (7, "a b c d e"), (9, "A b\nc d e")]
    assert result(spark, rows) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (7, 1, 7), (9, 1, 7)]


def test_null_ids_and_clashing_columns(spark):
    rows = [(None, "a b c d e f", 1, "x"), (3, "a b c d e f", 2, None), (None, "q r", 3, "y")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept int, component_id string"))
    seen = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got.collect())
    assert seen == [("3", "3", True), ("None", "3", False), ("None", "None", True)]
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_empty_table(spark):
    assert result(spark, []) == []


def test_very_long_text(spark):
    long = " ".join(f"w{i % 9973}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "short text of five words here")]
    assert [c for _, _, c in result(spark, rows)] == [1, 1, 3]


def test_versions_of_one_id_share_their_links(spark):
    a, b = "a b c d e f g h i j", "q r s t u v w x y z"
    assert result(spark, [(3, a), (5, a), (5, b), (8, b + " x")]) == [(3, 6, 3), (5, 6, 3), (5, 6, 3), (8, 7, 3)]
    rows = [(k // 2, t) for k, t in enumerate(texts(5, 8, 6, 3))] + [(900, a), (901, b), (900, b)]
    assert result(spark, rows) == brute(rows)


def test_blocks_are_bounded_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "WEIGHT", 300)
    rows = list(enumerate(texts(6, 3, 20, 3)))
    assert result(spark, rows) == brute(rows)
