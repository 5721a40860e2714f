from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.operators import documents, drift, fleet, ledger, packs, parsing, report, validation
from plumbline.plans import audit, rules
from plumbline.sources import bundle
from tests.fleet_configs import ALL, files


@pytest.fixture(scope="module")
def result(spark):
    unseen = "sysname x\n#\nuser-interface vty 0 4\n idle-timeout 12 0\n#\nreturn\n"
    return audit.run(files(spark, ALL | {"unseen": unseen, "broken": ALL["panos"].replace("</config>", "")}))


@pytest.fixture(scope="module")
def docs(result):
    return {r.device_id: r.asDict(True) for r in result.documents.collect()}


def test_identity(result):
    got = {r.device_id: (r.vendor, r.serial, r.version) for r in result.devices.collect()}
    assert {k: v[0] for k, v in got.items()} == {"ios": "cisco", "eos": "arista", "junos": "juniper", "fortios": "fortinet", "routeros": "mikrotik", "panos": "paloalto", "unseen": "unknown", "broken": "paloalto"}
    assert got["routeros"][1:] == ("ABC123", "7.14")


def test_management_facts(docs):
    m = {k: v["mgmt"] or {} for k, v in docs.items()}
    assert {k: m[k].get("telnet_enabled") for k in m} == {"ios": True, "eos": False, "junos": False, "fortios": True, "routeros": True, "panos": False, "unseen": None, "broken": None}
    assert {k: m[k].get("http_enabled") for k in ("ios", "eos", "junos", "fortios", "routeros", "panos")} == {"ios": True, "eos": None, "junos": False, "fortios": True, "routeros": False, "panos": True}
    assert {k: m[k].get("idle_timeout_min") for k in ("ios", "eos", "junos", "fortios")} == {"ios": 10, "eos": 10, "junos": 10, "fortios": 30}
    assert m["ios"]["mgmt_acl"] == "MGMT" and m["ios"]["login_banner"] is True and m["ios"]["ssh"]["version"] == 2
    assert docs["unseen"]["mgmt"] is None and docs["unseen"]["interfaces"] is None


def test_names_and_servers(docs):
    assert {k: docs[k]["device"]["hostname"] for k in ALL} == {"ios": "core", "eos": "leaf", "junos": "edge", "fortios": "fw", "routeros": "branch", "panos": "pa"}
    assert all(docs[k]["ntp"]["servers"] == ["10.0.0.1"] for k in ALL)
    assert {k: docs[k]["ntp"]["authenticated"] for k in ALL} == {"ios": False, "eos": True, "junos": False, "fortios": False, "routeros": False, "panos": False}


def test_accounts_keep_no_secret(docs, result):
    users = {k: [(u["name"], u["hash"]) for u in docs[k]["aaa"]["local_users"]] for k in ("ios", "eos", "junos", "fortios", "routeros")}
    assert users == {"ios": [("ops", "scrypt"), ("old", "reversible")], "eos": [("ops", "sha512")], "junos": [("ops", "sha512")], "fortios": [("admin", None)], "routeros": [("ops", None)]}
    assert docs["eos"]["snmp"]["communities"] == ["custom"] and docs["ios"]["snmp"]["communities"] == ["default"]
    cited = result.evidence().where(F.contains("raw", F.lit("0822455D0A16")) | F.contains("raw", F.lit("$9$abc")))
    assert cited.count() == 0


def test_interfaces_and_lists(docs):
    ios = docs["ios"]["interfaces"]
    assert [(i["name"], i["addresses"], i["is_mgmt"], i["acl_in"]) for i in ios] == [("GigabitEthernet0/1", ["198.51.100.3"], False, None), ("Vlan900", ["10.9.0.3/24"], True, "MGMT")]
    e = docs["ios"]["acls"][0]["entries"]
    assert [(x["seq"], x["action"], x["protocol"], x["src"], x["dst"], x["dst_port"]) for x in e] == [(10, "permit", "ip", "any", "any", None), (20, "deny", "tcp", "10.0.0.0/24", "any", "eq 22"), (30, "permit", "tcp", "10.1.1.1/32", "any", "80-443")]
    assert [(i["name"], i["shutdown"], i["acl_in"]) for i in docs["junos"]["interfaces"]] == [("ge-0/0/0", False, None), ("ge-0/0/1", True, "CORE")]
    assert docs["routeros"]["interfaces"][0]["description"] == "wan side"
    assert [i["name"] for i in docs["panos"]["interfaces"]] == ["management", "ethernet1/1"] and docs["panos"]["interfaces"][0]["addresses"] == ["10.0.0.10/24"]


def test_coverage_adds_up(result):
    for r in result.coverage.collect():
        assert r.parsed_lines + r.unparsed_lines == r.total_lines == r.parsed_lines + len(r.unparsed_sample)
    rest = {(s.file, s.raw.strip()) for r in result.coverage.collect() if r.device_id in ("ios", "fortios", "routeros", "panos") for s in r.unparsed_sample}
    assert rest == {("running", "unknown-thing 7"), ("running", "exec-timeout 5 0"), ("running", "set mystery yes"), ("running", "/tool something add x=1"), ("running", "<mystery>1</mystery>")}


def test_one_broken_device_is_isolated(result):
    assert [r.device_id for r in result.errors.collect()] == ["broken"]
    assert result.findings.where("device_id in ('broken', 'unseen') and verdict = 'pass'").count() == 0


def test_verdicts_and_score(result):
    v = {(r.device_id, r.rule_id[8:]): r.verdict for r in result.findings.collect()}
    assert [v["ios", k] for k in ("1.1.1", "1.1.2", "1.2.4", "1.3.1", "1.4.1", "2.1.1", "2.1.2", "5.2.1", "5.3.1", "6.1.1")] == ["fail", "pass", "pass", "fail", "pass", "fail", "fail", "fail", "unknown", "fail"]
    s = {r.device_id: r for r in result.summary().collect()}
    assert s["unseen"].score == 0 and s["unseen"].n_unknown == 13
    assert all(r.n_pass + r.n_fail + r.n_unknown + r.n_not_applicable == 13 for r in s.values())
    assert result.exit_code() == 1


def test_evidence_cites_lines(result):
    e = {(r.rule_id[8:], r.ir_path): r for r in result.evidence().where("device_id = 'ios'").collect()}
    assert e["1.1.1", "mgmt.telnet_enabled"].raw.strip() == "transport input telnet ssh"
    assert len(e["1.1.1", "mgmt.telnet_enabled"].excerpt) == 7 and e["2.1.2", "snmp.communities"].raw == "snmp-server community <redacted> RO"


def test_fleet(result):
    found = result.correlations().collect()
    ids = [r.id for r in found]
    assert "FLEET-NTP-DRIFT" in ids and sum(i.startswith("FLEET-CREDENTIAL") for i in ids) == 1
    shared = next(r for r in found if r.id.startswith("FLEET-CREDENTIAL"))
    assert shared.devices == ["eos", "junos"]
    assert {"FLEET-SHADOW-ios-MGMT-20": "high", "FLEET-SHADOW-ios-MGMT-30": "medium"}.items() <= {r.id: r.severity for r in found}.items()
    ranked = fleet.rank(result.correlations()).collect()
    assert [r.score for r in ranked] == sorted((r.score for r in ranked), reverse=True)
    segments = {(r.device_id, r.segment) for r in result.graph().collect()}
    assert ("fortios", "10.0.0.0/24") in segments and ("ios", "10.9.0.0/24") in segments


def test_reports(result):
    text = {r.device_id: r.report for r in report.markdown(result.reports()).collect()}
    assert "## Findings" in text["ios"] and "CIS-NET-1.1.1" in text["ios"] and len(text) == 8
    assert text["ios"].count("\n## ") == 7 and "transport input telnet ssh" in text["ios"] and "no ip telnet server" in text["ios"] and "unknown-thing 7" in text["ios"]
    assert "0822455D0A16" not in text["ios"] and "$9$abc" not in text["ios"]
    assert "# Fleet" in fleet.report(result.correlations()).first().report


def test_drift_and_holdout(spark, result):
    changed = ALL["ios"].replace("transport input telnet ssh", "transport input ssh").replace("exec-timeout 10 0", "exec-timeout 45 0")
    other = audit.run(files(spark, {"ios": changed}))
    one = result.findings.where("device_id = 'ios'")
    moved = {r.rule_id[8:]: (r.before, r.after, r.change) for r in drift.verdict_changes(one, other.findings).collect()}
    assert moved == {"1.1.1": ("fail", "pass", "improvement"), "1.2.4": ("pass", "fail", "regression")}
    facts = {r.ir_path: (r.before, r.after) for r in drift.fact_changes(result.facts.where("device_id = 'ios'"), other.facts).collect()}
    assert facts == {"mgmt.telnet_enabled": ("true", "false"), "mgmt.idle_timeout_min": ("10", "30")}
    with pytest.raises(drift.DriftError):
        drift.same_devices(result.findings, other.findings)


def test_learned_pack(spark):
    pack = packs.Pack("p1", "unknown", None, (packs.Mapping("mgmt.idle_timeout_min", r"^idle-timeout (?P<value>\d+)", "to_int", within="^user-interface vty"), packs.Mapping("mgmt.telnet_enabled", r"^telnet server (?P<value>\w+)", "to_bool")))
    text = "user-interface vty 0 4\n idle-timeout 12 0\ntelnet server enable\ntelnet server disable\ntelnet server maybe\n"
    with pytest.raises(packs.PackError):
        packs.admit([pack], set())
    got = audit.run(files(spark, {"u": text}), learned=packs.admit([pack], {pack.digest()}))
    d = got.documents.first()
    assert d.mgmt.idle_timeout_min == 12 and d.mgmt.telnet_enabled is True
    assert got.coverage.first().tier2 == 3 and got.coverage.first().unparsed_lines == 2
    with pytest.raises(packs.PackError):
        packs.safe_pattern("(a+)+")


def test_validation(spark, result):
    labels = spark.createDataFrame([("ios", "CIS-NET-1.1.1", "fail"), ("ios", "CIS-NET-1.1.2", "pass"), ("eos", "CIS-NET-1.1.2", "fail")], "device_id string, rule_id string, expected string")
    r = validation.verdicts(result.findings, labels).first()
    assert (r.tp, r.fp, r.fn, r.cautious, r.precision, r.recall) == (1, 0, 0, 1, 1.0, 0.5)
    facts = spark.createDataFrame([("ios", "mgmt.telnet_enabled", "true", 50), ("eos", "mgmt.mgmt_acl", None, None), ("ios", "ntp.servers", "10.0.0.2", None)], "device_id string, ir_path string, value string, line int")
    assert validation.fact_accuracy(result.facts, facts).first().right == 2


def test_ledger(spark):
    entries = ledger.append([], [{"timestamp": "t", "report_id": f"r{k}", "device_id": "d\"é", "merkle_root": "0", "rule_set_digest": "x", "ir_schema_version": "1.0.0"} for k in range(4)])
    df = spark.createDataFrame(entries, ledger.ENTRY)
    assert ledger.verify(df).count() == 0
    bad = df.withColumn("merkle_root", F.when(F.col("seq") == 2, "1").otherwise(F.col("merkle_root")))
    assert [(r.seq, r.problem) for r in ledger.verify(bad).collect()] == [(3, "the chain is broken")]
    with pytest.raises(ledger.LedgerError):
        ledger.canonical({"a": [1.5]})


def test_residue_and_rules(result):
    left = documents.residue(result.lines, result.facts)
    assert left.count() == sum(r.unparsed_lines for r in result.coverage.collect())
    assert len(rules.SHIPPED) == 13 and rules.digest(rules.SHIPPED) == rules.digest(rules.SHIPPED[::-1])


def test_secrets_are_fingerprints(result):
    assert result.facts.where("secret is not null and (length(secret) <> 32 or secret rlike '[^0-9a-f]')").isEmpty()
    assert result.facts.where("secret is not null").count() > 4


def test_deep_blocks_stay_unread(spark):
    text = "version 1.0R1;\n" + "".join(f"{'    ' * k}b{k} {{\n" for k in range(20)) + "host-name x;\n" + "".join("}\n" for _ in range(20)) + "system {\n    host-name y;\n}\n"
    got = audit.run(files(spark, {"deep": text + "interfaces {\n    ge-0/0/0 {\n        unit 0 {\n        }\n    }\n}\n"}))
    c = got.coverage.first()
    assert got.documents.first().device.hostname == "y" and 0 < c.unparsed_lines < c.total_lines / 2


def test_files_on_disk(spark, tmp_path):
    from plumbline.sources import bundle
    from plumbline.streaming import watch

    root = tmp_path / "a+b" / "data" / "data"
    for name in ("x", "y"):
        (root / name).mkdir(parents=True)
        (root / name / "running.cfg").write_text(ALL["ios"] if name == "x" else ALL["eos"])
    assert {(r.device_id, r.file) for r in bundle.load(spark, str(root)).collect()} == {("x", "running.cfg"), ("y", "running.cfg")}
    assert [(r.device_id, r.file) for r in bundle.load(spark, str(root / "x" / "running.cfg")).collect()] == [("running", "running.cfg")]
    for bad in (str(tmp_path / "none"), str(tmp_path / "empty")):
        (tmp_path / "empty").mkdir(exist_ok=True)
        with pytest.raises(bundle.BundleError):
            bundle.load(spark, bad)
    big = spark.createDataFrame([("d/a.cfg", b"x" * 20)], "path string, content binary")
    old, bundle.MOST_BYTES = bundle.MOST_BYTES, 10
    try:
        with pytest.raises(Exception, match="larger than"):
            bundle.source_files(big).collect()
    finally:
        bundle.MOST_BYTES = old
    # a device whose files arrive apart is audited whole each time
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    watch.run(spark, str(root), out, check).awaitTermination()
    (root / "x" / "show-version.txt").write_text("Processor board ID FTX9\n")
    watch.run(spark, str(root), out, check).awaitTermination()
    later = spark.read.parquet(f"{out}/findings/batch=1")
    assert {r.device_id for r in later.select("device_id").distinct().collect()} == {"x"} and later.where("verdict = 'fail'").count() > 3


def test_artefacts_and_commands(spark, tmp_path, capsys):
    import json

    from plumbline import cli

    root = tmp_path / "fleet"
    for name, text in ALL.items():
        (root / name).mkdir(parents=True)
        (root / name / ("running.xml" if name == "panos" else "running.cfg")).write_text(text)
    out = str(tmp_path / "out")
    a = audit.audit(spark, str(root))
    audit.write(a, out)
    assert drift.rules_changed(*[drift.written_verdicts(spark, f"{out}/audits")] * 2).isEmpty()
    docs = [json.loads(r.value) for r in spark.read.text(f"{out}/documents").collect()]
    assert len(docs) == len(ALL) and all(list(d) == sorted(d) for d in docs)
    a.discard()
    with pytest.raises(Exception):
        a.lines.count()
    pack = {"id": "p", "vendor": "v", "mappings": [{"ir_path": "aaa.enabled", "match": "^aaa", "transform": "presence"}]}
    (tmp_path / "p.json").write_text(json.dumps(pack))
    assert cli.main(["pack", str(tmp_path / "p.json")]) == 0 and cli.main(["trust", str(tmp_path / "p.json"), "--trusted", str(tmp_path / "t.json")]) == 0
    assert len(json.loads((tmp_path / "t.json").read_text())) == 1 and cli.main(["rules"]) == 0
    assert "CIS-NET-6.1.1" in capsys.readouterr().out


def test_no_local_folder_on_a_cluster(monkeypatch):
    from plumbline.sources import tables

    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(tables.NoSharedFolder):
        tables.stage_dir(Cluster, "x")


def test_documents_in_xml_are_read_by_many_tasks(spark):
    rows = files(spark, {f"p{k}": ALL["panos"] for k in range(40)})
    read = parsing.panos(bundle.lines(rows))
    assert read.select(F.spark_partition_id()).distinct().count() > 1
    per = read.where("path is not null").groupBy("device_id").agg(F.count("*").alias("n")).collect()
    assert len(per) == 40 and len({r.n for r in per}) == 1 and per[0].n > 5


def test_lines_that_findings_share_are_scrubbed_once(result):
    plan = result.evidence()._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(" in plan and plan.index("inline(") < plan.index("regexp_replace(")


def test_written_audits_are_made_once(spark):
    from plumbline.catalog_text import written_audits
    from plumbline.sources.tables import recorded

    with recorded() as made:
        assert written_audits(spark, "/root/testdata/sf0.001").count() > 0
    assert any("/audits-" in folder for folder in made)


def test_what_grows_with_the_lines_is_not_broadcast(result):
    left = documents.residue(result.lines, result.facts)
    for df in (left, result.coverage, result.evidence(), result.reports()):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
