from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import negatives
from plumbline.llm.negatives import Rotation, Slice, hard_negatives, integers, products, survivors

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows):
    held = {}
    for i, label, v in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None), key=lambda r: (r[0], (r[1] + (r[0] % 7 == 0)) % 10 if r[0] % 7 == 0 else r[1], [x if x is not None else math.nan for x in r[2]])):
        if all(x is not None and math.isfinite(x) for x in v):
            held.setdefault(i, ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, (label, v) in held.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in held.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if held[i][0] == label][:5]:
            fit = [i for i in order if held[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:5]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit)]
    return sorted(out)


def made(seed, n=900, width=12, labels=10):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(labels, width)) * np.linspace(1, 0.1, width)
    rows = []
    for k in range(n):
        label = int(rng.integers(labels))
        rows.append((k, label, (centre[label] * 0.1 + rng.normal(size=width) * np.linspace(0.5, 0.05, width)).astype(np.float32).tolist()))
    return rows


def result(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(4)
    return sorted(map(tuple, hard_negatives(df).select(*COLUMNS).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = made(seed)
    got = result(spark, rows)
    assert got == brute(rows) and len(got) > 100


def test_in_slices_and_small_blocks(spark, monkeypatch):
    rows = made(3, 700)
    monkeypatch.setattr(negatives, "SLICE", 3)
    got = result(spark, rows)
    assert got == brute(rows) and len({g[0] for g in got}) > 3


def test_ties_copies_nulls_and_repeats(spark):
    rows = made(4, 300, 6, 3)
    rows += [(1000 + k, k % 3, rows[5][2]) for k in range(200)] + [(2000, 1, rows[5][2]), (2100, 1, [0.0] * 6), (2200, 4, [1.0, 2.0]), (2201, 4, [1.0] * 6), (2202, 5, []), (2203, 6, [1.0] * 6)]
    rows += [(None, 1, [1.0] * 6), (3000, None, [1.0] * 6), (3100, 1, None), (3200, 1, [1.0, None, 0.0]), (3300, 1, [math.nan] * 6), (3400, 1, [math.inf] * 6), rows[3], rows[100], (100, 0, [-3.0] * 6)]
    got = result(spark, rows)
    assert got == brute(rows) and any(g[0] == 2000 for g in got)


def test_nothing(spark):
    assert result(spark, []) == [] and result(spark, [(1, 1, [1.0]), (3, 1, [1.0])]) == [] and result(spark, [(100, 1, [1.0])]) == []
    df = spark.createDataFrame([(100, 1, [1.0], "x")], "vec_id long, label int, embedding array<float>, anchor string")
    assert hard_negatives(df).columns == COLUMNS


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(5)
    vectors = integers(pa.array((rng.normal(size=(400, 40)) * np.linspace(2, 0.01, 40)).tolist(), pa.list_(pa.float32())), 40)
    held = Slice(np.arange(50), np.zeros(50), vectors[:50], Rotation(vectors))
    assert held.rotation.ends
    exact = vectors @ vectors[:50].T
    need = np.quantile(exact, 0.99, axis=0)
    found = {(int(i), int(j)): int(s) for a, b, c in survivors(held, vectors, lambda s: np.ones((400, 50), bool)[:, s], need) for i, j, s in zip(a, b, c)}
    assert found == {(i, j): int(exact[i, j]) for i, j in zip(*np.nonzero(exact >= need))}


def test_large_components_are_exact():
    a, b = np.array([[2.0**30, 3.0], [1e30, 1.0]]), np.array([[2.0**25 + 1, 1.0], [1e30, 1.0]])
    assert products(a, b).tolist() == [2**55 + 2**30 + 3, negatives.MOST]


def test_oracle(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = made(6, 400)
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, label integer, embedding float[])")
    con.executemany("insert into embeddings values (?, ?, ?)", rows)
    got = con.execute(negatives.ORACLE)
    assert [d[0] for d in got.description] == COLUMNS and sorted(map(tuple, got.fetchall())) == brute(rows)
