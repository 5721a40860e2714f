"""Drift as a stream: restarts, late and repeated audits; and the sink of named files."""

from __future__ import annotations

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.plans import audit
from plumbline.sources import artefacts
from plumbline.streaming import changes
from tests.fleet_configs import ALL, files

DAY = datetime(2024, 1, 1)


def test_changes_over_restarts(spark, tmp_path):
    own = changes.session(spark)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    kind = "device_id string, at timestamp, verdicts map<string,string>"

    def put(name: str, rows: list[tuple]) -> None:
        spark.createDataFrame([(d, DAY + timedelta(days=k) if k is not None else None, v) for d, k, v in rows], kind).coalesce(1).write.parquet(f"{source}/{name}")

    def run() -> list[tuple]:
        stream = own.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(source)
        changes.run(changes.changes(stream), out, checkpoint).awaitTermination()
        return sorted((r.device_id, (r["at"] - DAY).days, r.rule_id, r.before, r.after, r.change) for r in changes.told(spark, out).collect())

    put("a", [("x", 1, {"r": "pass", "s": "fail"}), ("x", 2, {"r": "fail", "s": "fail"}), ("y", 1, {"r": "pass"}), (None, 1, {"r": "fail"}), ("z", None, {"r": "fail"}), ("z", 1, None), ("e", 1, {})])
    first = [("x", 2, "r", "pass", "fail", "regression")]
    assert run() == first and run() == first  # nothing new, nothing told
    put("b", [("x", 4, {"r": "fail", "t": "fail"}), ("x", 3, {"r": "unknown", "s": "pass"}), ("x", 2, {"r": "pass", "s": "pass"}), ("y", 0, {"r": "fail"}), ("e", 2, {"r": "pass"})])
    second = sorted(first + [("x", 3, "r", "fail", "unknown", "other"), ("x", 3, "s", "fail", "pass", "improvement"), ("x", 4, "r", "unknown", "fail", "regression"), ("x", 4, "s", "pass", "absent", "other"), ("x", 4, "t", "absent", "fail", "regression"), ("e", 2, "r", "absent", "pass", "other")])
    assert run() == second
    put("c", [("x", 4, {"r": "pass"})])  # the same audit again
    assert run() == second
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != changes.STORE  # the user's session


def test_written_audits_stream(spark, tmp_path):
    own = changes.session(spark)
    result = audit.run(files(spark, {"ios": ALL["ios"]}))
    reports = result.reports()
    reports.write.json(f"{tmp_path}/in/a")
    run = lambda: changes.run(changes.changes(changes.written_audits(own, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    run()
    gone = reports.withColumn("findings", F.filter("findings", lambda f: f["verdict"] != "fail"))
    gone.write.json(f"{tmp_path}/in/b")
    run()
    failed = {r.rule_id for r in result.findings.where("verdict = 'fail'").collect()}
    assert failed and {(r.rule_id, r.before, r.after) for r in changes.told(spark, f"{tmp_path}/out").collect()} == {(r, "fail", "absent") for r in failed}


def test_named_files(spark, tmp_path):
    out = f"file://{tmp_path}/files"
    rows = [("a.json", "1"), ("b/../../c", "é"), (".hidden", None), ("_x", ""), ("d", "long " * 100_000)]
    artefacts.write_files(spark.createDataFrame(rows, "name string, value string").repartition(3), out)
    read = lambda: {n: open(f"{tmp_path}/files/{n}", encoding="utf-8").read() for n in os.listdir(f"{tmp_path}/files")}
    assert read() == {"a.json": "1", "b%2F..%2F..%2Fc": "é", "%2Ehidden": "", "%5Fx": "", "d": "long " * 100_000, "_SUCCESS": ""}
    artefacts.write_files(spark.createDataFrame([("a.json", "2"), ("e", "x"), ("e", "y")], "name string, value string").coalesce(1), out, "append")
    assert read()["a.json"] == "2" and read()["e"] == "xy" and "d" in read()
    artefacts.write_files(spark.createDataFrame([], "name string, value string"), out)
    assert read() == {"_SUCCESS": ""}
    for bad in ([(None, "x")], [("", "x")]):
        with pytest.raises(Exception, match="needs a name"):
            artefacts.write_files(spark.createDataFrame(bad, "name string, value string"), out)
        assert read() == {}


def test_artefacts_of_an_audit(spark, tmp_path):
    result = audit.run(files(spark, ALL))
    for name in ("one", "two"):
        audit.write(result, f"{tmp_path}/{name}")
    names = {f"{d}.{end}" for d in ALL for end in ("ir.json", "audit.json", "md")}
    assert set(os.listdir(f"{tmp_path}/one/devices")) == names | {"_SUCCESS"}
    for n in names | {"../fleet-report/fleet.json", "../fleet-report/fleet.md"}:
        a, b = (open(f"{tmp_path}/{k}/devices/{n}", encoding="utf-8").read() for k in ("one", "two"))
        assert a == b and a
        if n.endswith(".json") and "fleet" not in n:
            assert a == json.dumps(json.loads(a), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    fleet = json.load(open(f"{tmp_path}/one/fleet-report/fleet.json", encoding="utf-8"))
    assert len(fleet) == result.correlations().count() and {f["id"] for f in fleet} == {r.id for r in result.correlations().collect()}
    assert json.load(open(f"{tmp_path}/one/devices/ios.audit.json"))["device_id"] == "ios"


def test_fleet_file_without_findings(spark):
    empty = spark.createDataFrame([], "id string, severity string")
    assert [r.value for r in audit.fleet_file(empty).collect()] == ["[]\n"]
