"""What is staged is deleted again."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from plumbline import cli
from plumbline.operators import fleet
from plumbline.plans import audit, rules
from plumbline.sources import tables
from tests.fleet_configs import ALL, files


def there(spark) -> set[str]:
    root = tables._root(spark).removeprefix("file://") + "/stages"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_an_audit_leaves_nothing(spark):
    before = there(spark)
    result = audit.run(files(spark, ALL))
    result.correlations().count()
    assert len(there(spark) - before) > 7  # superseded tables and fronts too
    result.discard()
    assert there(spark) == before


def test_a_failed_audit_leaves_nothing(spark, monkeypatch):
    def fail(*_):
        raise ValueError("in the middle")

    before = there(spark)
    monkeypatch.setattr(rules, "findings", fail)
    with pytest.raises(ValueError):
        audit.run(files(spark, {"ios": ALL["ios"]}))
    assert there(spark) == before


def test_commands_leave_nothing(spark, tmp_path, capsys):
    for name in ("ios", "junos"):
        (tmp_path / "f" / name).mkdir(parents=True)
        (tmp_path / "f" / name / "running.cfg").write_text(ALL[name])
    before = there(spark)
    assert cli.main(["drift", str(tmp_path / "f"), str(tmp_path / "f")]) == 0 and cli.main(["fleet", str(tmp_path / "f")]) == 0
    assert there(spark) == before


def test_scopes_nest(spark):
    before = there(spark)
    with tables.scope(spark), tables.recorded() as outer:
        with tables.recorded() as inner:
            tables.staged(spark.range(3), "a")
        kept = tables.staged(spark.range(2), "b")
        assert len(inner) == 1 and len(outer) == 2 and kept.count() == 2
    assert there(spark) == before
    with pytest.raises(ValueError), tables.scope(spark):
        tables.staged(spark.range(3), "a")
        raise ValueError
    assert there(spark) == before


def test_an_unreadable_address_is_covered_by_nothing(spark):
    entry = "struct<protocol:string,src:string,dst:string,dst_port:string>"
    rows = [("any", "10.0.0.0/8", True), ("any", None, True), ("any", "somewhere", False), ("any", "10.0.0.0", True), ("10.0.0.0/8", "10.2.3.4", True), ("10.2.3.4", "10.2.3.4/32", True), ("10.2.3.4", "10.2.3.5", False), ("any", "2001:db8::/32", True), ("10.0.0.0/8", "10.1.0.0/16", True), ("10.0.0.0/8", "any", False), ("x", "10.0.0.0/8", False)]
    df = spark.createDataFrame([(("ip", a, "any", None), ("tcp", b, "any", None), want) for a, b, want in rows], f"a {entry}, b {entry}, want boolean")
    got = df.select("a.src", F.col("b.src").alias("other"), "want", fleet.covers(F.col("a"), F.col("b")).alias("got")).collect()
    assert [(r.src, r.other, r.got) for r in got] == [(r.src, r.other, r.want) for r in got]
