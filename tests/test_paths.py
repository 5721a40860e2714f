from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import drift, paths, validation
from plumbline.plans import audit
from tests.fleet_configs import IOS, files


def flat(df):
    return {r.ir_path: r.value for r in df.collect()}


def test_paths_of_typed_documents(spark):
    df = spark.sql("SELECT 'd' AS device_id, named_struct('a', 1, 'b', array(named_struct('x', 'p', 'y', array('q', 'r')), named_struct('x', null, 'y', array()))) AS s, true AS t, cast(null AS struct<z:int>) AS n, array(1, 2) AS l")
    assert flat(paths.document_paths(df)) == {"s.a": "1", "s.b[0].x": "p", "s.b[0].y": "q,r", "s.b[1].y": "", "t": "true", "l": "1,2"}
    assert paths.document_paths(df.limit(0)).count() == 0


def test_paths_of_json_of_any_depth(spark):
    deep = '{"k":' * 9 + "[1,{\"x\":[]}]" + "}" * 9
    df = spark.createDataFrame([("d", deep), ("e", "{broken"), ("f", None)], "device_id string, value string")
    assert flat(paths.json_paths(df, "device_id", "value")) == {".".join("k" * 9) + "[0]": "1", ".".join("k" * 9) + "[1].x": ""}


def test_members_in_drift_and_accuracy(spark):
    before = audit.run(files(spark, {"ios": IOS}))
    names = [i.name for i in before.documents.first().interfaces]
    entries = before.documents.first().acls
    text = IOS.replace("secret 9 ", "secret 9 x", 1)
    after = audit.run(files(spark, {"ios": text}))
    changed = {r.ir_path for r in drift.fact_changes(before.facts, after.facts).collect()}
    assert changed and all(c.startswith("aaa.local_users[") and c.endswith("hash_fingerprint") for c in changed)
    assert {r.ir_path for r in drift.document_changes(before.documents, after.documents).collect()} == changed
    # every member that a document lists has the same value by its facts
    facts = {r.ir_path: r.value for r in paths.indexed(before.facts).where("op = 'set'").collect()}
    listed = flat(paths.document_paths(before.documents))
    both = [p for p in facts if "[" in p and p in listed]
    assert len(both) > 20 and all(facts[p] == listed[p] for p in both)
    labels = spark.createDataFrame([("ios", f"interfaces[{k}].name", n, None) for k, n in enumerate(names)] + [("ios", "acls[0].name", entries[0].name, None), ("ios", "interfaces[99].name", "x", None), ("ios", "interfaces[98].name", None, None)], validation.FACT_LABEL)
    got = validation.fact_accuracy(before.facts, labels).first()
    assert (got.facts, got.right) == (len(names) + 3, len(names) + 2)
    assert paths.indexed(before.facts.limit(0)).count() == 0 and drift.fact_changes(before.facts, before.facts).count() == 0
    gone = drift.fact_changes(before.facts, before.facts.where("path is null or path not like 'interfaces.%'"))
    assert gone.where("after is not null").count() == 0 and gone.where(F.col("ir_path").startswith("interfaces[0]")).count() > 0
