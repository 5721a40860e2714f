from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from plumbline.llm.trie import placed, prefix_trie, turn_rows

WORD = re.compile("[^\x20\x09-\x0d]+")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    made = {c: own.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + v[h:] for c, v in own.items()}
    members = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    children, saved, leaves = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        saved[p] = saved.get(p, 0) + ((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0)
        leaves[p] = leaves.get(p, 0) or 1
        if p:
            up = p[:-1]
            children[up] = children.get(up, 0) + 1
            saved[up] = saved.get(up, 0) + saved[p]
            leaves[up] = leaves.get(up, 0) + leaves[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(made[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    return sorted(map(tuple, prefix_trie(df).select(*COLUMNS).collect()), key=str)


def made(seed, convs=90):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(160), convs):
        for t in range(rng.randint(1, 7)):
            text = rng.choice(["", "hi there", "hi  there\tnow", "Ünïcode words", None, f"own {rng.randint(0, 3)}"])
            rows.append((c, rng.choice([t, t, None, t // 2]), rng.choice(["user", "assistant", None]), text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = made(seed)
    assert result(spark, rows) == brute(rows)


def test_copies_long_and_turnless_conversations(spark):
    long = [(t, "user", f"turn {t} " * (t % 3)) for t in range(60)]
    rows = [(c, *t) for c in (20, 33, 47, 48, 61) for t in long] + [(c, *t) for c in (70, 71) for t in long[:12]] + [(c, 0, "user", "one") for c in range(200, 260)]
    rows += [(None, 1, "user", "no id"), (300, None, None, None), (300, None, None, None), (-41, 3, "x", "y"), (-40, 3, "x", "y z")]
    assert result(spark, rows, 5) == brute(rows)


def test_only_turnless_and_empty(spark):
    alone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    assert result(spark, [(alone, 0, "user", "a b")]) == brute([(alone, 0, "user", "a b")])
    assert result(spark, []) == []


def test_places_across_partitions(spark):
    rows = [(5, t, "u", f"{t} x") for t in range(500)] + [(c, 0, "u", "z") for c in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("turn", "turn").repartition(4)
    got = placed(turn_rows(df))
    assert sorted(r.place for r in got.where("conv_id = 5").collect()) == list(range(1, 502))
    assert {r.place for r in got.where("conv_id <> 5").collect()} == {1}


def test_other_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, 0, "u", "a", 7, "q")], "conv_id long, turn long, role string, text string, depth int, `a.b` string")
    assert prefix_trie(df).columns == COLUMNS and prefix_trie(df).count() >= 1


def test_oracle(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from plumbline.llm.trie import ORACLE

    rows = made(5, 60)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    got = con.execute(ORACLE)
    assert [d[0] for d in got.description] == COLUMNS
    assert sorted(map(tuple, got.fetchall()), key=str) == brute(rows)
