"""Every registered query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from plumbline.catalog import ORACLES, QUERIES

SF = os.environ.get("PLUMBLINE_TABLES", "/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for n in NAMES:
        c.execute(f"create view {n} as select * from read_parquet('{SF}/{n}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_like_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in ORACLES:
        got = con.execute(ORACLES[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert sorted(tuple(plain(r[k]) for k in order) for r in got.fetchall()) == rows


def test_merkle_root_like_hashlib(spark):
    from pyspark.sql import functions as F

    from plumbline.operators.ledger import included, proof, root_of
    from plumbline.operators.relational import merkle_root

    import hashlib

    leaves = [[hashlib.sha256(bytes([k])).hexdigest() for k in range(n)] for n in range(10)]
    df = spark.createDataFrame([(x,) for x in leaves], "l array<string>")
    assert [r.r for r in df.select(merkle_root(F.col("l")).alias("r")).collect()] == [root_of(x) for x in leaves]
    assert all(included(x[k], proof(x, k), root_of(x)) for x in leaves for k in range(len(x)))
    assert not included(leaves[3][0], proof(leaves[3], 1), root_of(leaves[3]))


def test_proofs_like_the_plain_ones(spark):
    import hashlib

    from pyspark.sql import functions as F

    from plumbline.operators import ledger

    trees = [(n, [hashlib.sha256(bytes([k, n])).hexdigest() for k in range(n)]) for n in range(20)]
    made = ledger.proofs(spark.createDataFrame(trees, "n int, leaves array<string>"), ["n"])
    good = made.withColumns({"good": ledger.proves(F.col("leaf"), F.col("proof"), F.col("root")), "none": ledger.proves(F.lit(None).cast("string"), F.col("proof"), F.col("root"))})
    rows = good.collect()
    assert len(rows) == sum(range(20)) and all(r.good and not r.none for r in rows)
    for r in rows:
        leaves = trees[r.n][1]
        assert r.root == ledger.root_of(leaves) and [("left" if s.left else "right", s.hash) for s in r.proof] == ledger.proof(leaves, r["at"])
