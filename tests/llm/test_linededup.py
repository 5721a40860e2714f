from __future__ import annotations

import hashlib
import random

from plumbline.llm import linededup
from plumbline.llm.linededup import Runs, key_of, report, without_repeated_lines

BLANK = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    key = lambda line: line.strip(BLANK).translate(LOW)
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(d)
    last = {k: max(v, key=lambda d: (d is not None, d)) for k, v in holders.items() if len(v) >= 3}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return out


def rows(seed=1):
    rng = random.Random(seed)
    pool = [f"{'Ä' * (k % 3)}Line number {k} of the common pool" for k in range(30)] + ["x" * 19, "x" * 20, "ß" * 19, "ß" * 20, "日" * 20, "", "   "]
    made = []
    for d in range(120):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 12))] + [f"a line of its own, in document {d} only"]
        if d % 3 == 0:
            lines.insert(0, "THE ONE LINE that a third of all documents has")
        rng.shuffle(lines)
        made.append((d, "\n".join(rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", "\r", " "]) for x in lines)))
    pair = "this line stands in two documents alone"
    return [*made, (500, pair), (501, pair + "\n" + pair), (502, None), (503, ""), (504, "\n\n"), made[7], (7, "again with " + "x" * 20), (None, "x" * 20), (None, None), (505, "no end " * 90_000 + "\n" + "x" * 20)]


def test_like_brute_force(spark):
    made = rows()
    for batches in (1, 5):
        got = report(spark.createDataFrame(made, "doc_id long, text string").repartition(5), batches).collect()
        assert sorted(map(tuple, got), key=str) == sorted((r[:4] for r in brute(made)), key=str)


def test_texts_and_columns_stay(spark):
    made = rows(2)
    df = spark.createDataFrame([(i, t, "k", 5, "q") for i, t in made], "doc_id long, text string, key string, n_lines int, `own.t``x` string")
    got = without_repeated_lines(df)
    assert got.columns == df.columns
    texts = [r[4] if t is not None else None for r, (_, t) in zip(brute(made), made, strict=True)]
    assert sorted((str(r.doc_id), str(r.text), r[2], r[3], r[4]) for r in got.collect()) == sorted((str(i), str(t), "k", 5, "q") for (i, _), t in zip(made, texts, strict=True))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert report(empty).collect() == [] and without_repeated_lines(empty).collect() == []


def test_runs_settle_and_are_merged(spark):
    keys = {c: key_of(c.encode() * 20) for c in "abc"}
    runs = Runs(spark, fanout=3)
    batch = lambda pairs: spark.createDataFrame([(d, keys[c]) for d, c in pairs], "doc_id long, key binary")
    runs.add(batch([(90, "a"), (91, "a"), (99, "a"), (90, "b"), (90, "b")]))
    runs.add(batch([(10, "a"), (11, "a"), (10, "b")]))
    assert [r.key for r in runs.levels[0][1].collect()] == [bytearray(keys["b"])]  # a is settled
    assert {bytes(r.key): (r.n, r.last) for r in runs.repeated().collect()} == {keys["a"]: (3, 99)}
    runs.add(batch([(100, "a"), (5, "b"), (5, "c")]))
    assert [len(level) for level in runs.levels] == [0, 1]
    assert {bytes(r.key): (r.n, r.last) for r in runs.repeated().collect()} == {keys["a"]: (4, 100), keys["b"]: (3, 90)}
    runs.forget()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_runs_meet_without_shuffles(spark):
    runs = Runs(spark, fanout=9)
    for k in range(2):
        runs.add(spark.createDataFrame([(k * 10 + d, bytes([d]) * 16) for d in range(3)], "doc_id long, key binary"))
    plan = runs.repeated()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.forget()


def test_key_bounds():
    assert key_of(b"x" * 19) is None and key_of(" \t".encode() + b"X" * 20 + b"\r") == key_of(b"x" * 20)
    assert key_of("日".encode() * 19) is None and key_of("日".encode() * 20) is not None
    assert linededup.LEAST == 20 and linededup.DOCUMENTS == 3
