from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.plans.assertions import AssertionSyntaxError, compile_assertion, parse

DOC = "a struct<t:boolean,f:boolean,u:boolean,n:int,s:string,l:array<string>,e:array<string>,x:array<struct<h:string,d:boolean>>>, gone struct<q:int>"


@pytest.fixture(scope="module")
def doc(spark):
    row = ((True, False, None, 7, "hello", ["p", "q"], [], [("scrypt", False), (None, True)]), None)
    return spark.createDataFrame([row], DOC)


def value(doc, source):
    c = compile_assertion(source, doc.schema)
    r = doc.select(c.value.alias("v"), c.touched.alias("t"), c.missing.alias("m"), c.absent.alias("a")).first()
    return r.v, r.t, r.m, r.a


TABLE = [
    ("a.t and a.t", True), ("a.t and a.f", False), ("a.t and a.u", None), ("a.f and a.u", False), ("a.u and a.f", False),
    ("a.t or a.u", True), ("a.u or a.t", True), ("a.u or a.f", None), ("not a.u", None), ("not a.f", True), ("not not a.t", True),
    ("a.n == 7", True), ("a.n != 7", False), ("a.n <= 6", False), ("a.n > 6", True), ("a.u == true", None), ("a.t == 1", True),
    ("a.s == 7", False), ("a.s != 7", True), ("a.s < 7", None), ("a.n == null", False), ("null == null", True), ("null and a.u", False), ("not null", True), ("gone.q == null", None),
    ("a.s in [hello, x]", True), ("a.s in [x]", False), ('"ell" in a.s', True), ("a.n in [1, 7]", True), ("a.n in a.n", False), ("gone.q in [1]", None),
    ("defined(a.n)", True), ("defined(a.u)", False), ("defined(gone.q)", None), ("defined(a.zzz)", False),
    ("empty(a.e)", True), ("empty(a.l)", False), ("empty(gone.q)", None), ("empty(a.n)", False), ("count(a.l) == 2", True), ("count(a.n) == 1", None),
    ("all(a.e, x == 1)", True), ("any(a.e, x == p)", False), ("all(a.l, x in [p, q, r])", True), ("any(a.l, x in [q])", True), ("any(gone.q, x in [q])", None),
    ("all(a.x, u.h in [scrypt])", None), ("all(a.x, u.h in [md5])", False), ("any(a.x, u.h in [scrypt])", True), ("all(a.x, u.d or defined(u.h))", True), ("all(a.x, defined(u.h))", False),
    ("subset(a.l, [p, q, r])", True), ("subset([z], a.l)", False), ("subset(a.l, gone.q)", None), ("a.x[1].d", True), ("a.l[0] == \"p\"", True), ("a.l[9] == \"p\"", None),
]


def test_truth_tables(doc):
    compiled = [compile_assertion(s, doc.schema).value.cast("boolean").alias(f"c{k}") for k, (s, _) in enumerate(TABLE)]
    got = doc.select(*compiled).first()
    assert {s: got[k] for k, (s, _) in enumerate(TABLE)} == dict(TABLE)


def test_traces(doc):
    assert value(doc, "a.f and a.u") == (False, ["a.f"], [], [])
    assert value(doc, "a.t and a.u == true") == (None, ["a.t"], ["a.u"], [])
    assert value(doc, "a.t or a.u") == (True, ["a.t"], [], [])
    assert value(doc, "defined(a.u)") == (False, [], [], ["a.u"])
    assert value(doc, "defined(gone.q)") == (None, [], ["gone"], [])
    assert value(doc, "a.n == 7 and a.n <= 9") == (True, ["a.n"], [], [])
    assert value(doc, "all(a.x, defined(u.h))")[3] == ["u.h"]


@pytest.mark.parametrize("source", ["", "a ==", "a.n == 1.5", "a b", "(a", "f(a)", "defined(1)", "all(a)", "[a", "a == 1 == 2", "a & b", "and a"])
def test_malformed_texts_fail_before_any_job(source):
    with pytest.raises(AssertionSyntaxError):
        parse(source)


def test_keywords_in_any_case(doc):
    assert value(doc, "a.t AND NOT a.f OR False")[0] is True
    assert doc.select(F.lit(1)).count() == 1
