from __future__ import annotations

import io
import json
import zipfile

import pytest

from plumbline.plans import rules
from plumbline.sources import benchmarks, xccdf

TEXT = """<Benchmark xmlns="http://checklists.nist.gov/xccdf/1.2"><Group id="V-1"><Rule id="SV-1" severity="high"><version>NET-1</version><title>T</title>
<description>&lt;VulnDiscussion&gt;why&lt;/VulnDiscussion&gt;</description><ident system="http://cyber.mil/cci">CCI-1</ident><fixtext>do <b>it</b></fixtext></Rule></Group>
<Group id="V-2"><Group id="V-3"><Rule id="SV-3" severity="odd"><version></version><title>U</title></Rule></Group></Group></Benchmark>"""
OWN = [
    {"vuln_id": "v-1", "assert": "mgmt.telnet_enabled == false", "remediation": {"cisco_ios": ["no telnet"]}, "frameworks": ["OWN:1"], "applies_to": {"vendor": ["cisco"]}, "severity": "LOW"},
    {"stig_id": "NET-1", "assert": "mgmt.http_enabled == false"}, {"vuln_id": "V-3", "assert": "snmp.version == 3"},
]


def test_bad_files_leave_the_others(spark):
    rows = [("good", TEXT, 1), ("again", TEXT, 1), ("again", TEXT, 1), ("none", None, 1), ("empty", "", 1), ("dtd", "<!DOCTYPE x>" + TEXT, 1), ("broken", TEXT[:-3], 1), ("bare", "<Benchmark/>", 1), ("long", TEXT.replace("why", "why " * 200_000), 1)]
    got = benchmarks.parse(spark.createDataFrame(rows, "file string, text string, error int")).collect()
    assert {r.file: r.error for r in got if r.error} == {"none": "the benchmark has no text", "empty": "not well-formed", "dtd": "a document type is refused", "broken": "not well-formed", "bare": "the benchmark has no controls"}
    plain = xccdf.controls(TEXT)
    read = lambda name: [tuple(r)[2:-1] for r in got if r.file == name]
    assert read("good") == plain and len(read("again")) == 2 * len(plain) and len(read("long")) == len(plain)
    assert benchmarks.parse(spark.createDataFrame([], "file string, text string")).count() == 0


def test_files_and_archives(spark, tmp_path, monkeypatch):
    (tmp_path / "a.xml").write_bytes(b"\xef\xbb\xbf" + TEXT.encode())
    for name, members in (("b.zip", {"x/U_own-xccdf.xml": TEXT, "readme.txt": "-"}), ("c.zip", {"readme.txt": "-"})):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as archive:
            for member, text in members.items():
                archive.writestr(member, text)
        (tmp_path / name).write_bytes(held.getvalue())
    (tmp_path / "d.zip").write_bytes(b"PK no archive")
    monkeypatch.setattr(benchmarks, "MOST_BYTES", 5000)
    (tmp_path / "e.xml").write_text(TEXT + " " * 5000)
    got = benchmarks.parse(benchmarks.files(spark, str(tmp_path))).collect()
    told = {r.file.rsplit("/", 1)[1]: r.error for r in got}
    assert told["a.xml"] is told["b.zip"] is None and told["c.zip"] == "the archive holds no benchmark" and told["d.zip"] and told["e.xml"]
    assert sorted(r.vuln_id for r in got if r.error is None) == ["V-1", "V-1", "V-3", "V-3"]


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_bindings_like_the_plain_ones(spark, monkeypatch, most):
    monkeypatch.setattr(benchmarks, "BROADCAST_BYTES", most)
    own = [xccdf.Binding.of(b) for b in OWN]
    parsed = benchmarks.parse(spark.createDataFrame([("f", TEXT)], "file string, text string"))
    made, manual = xccdf.bind(xccdf.controls(TEXT), own, rules.SHIPPED)
    got = benchmarks.bind(parsed, own, rules.SHIPPED).orderBy("place").collect()
    like = [rules.Rule(r.rule, r.rule_severity, r.assertion, r.title, tuple(r.frameworks), r.discussion or r.title, {x.vendor: tuple(x.steps) for x in r.fixes}, tuple(r.vendors), tuple(r.roles)) for r in got if r.bound]
    assert like == made and len(made) == 2 and [r.vuln_id for r in got if not r.bound] == [m[0] for m in manual]
    assert {(r.severity, r.controls, r.checked) for r in benchmarks.counts(benchmarks.bind(parsed, own[2:], [])).collect()} == {("critical", 1, 0), ("info", 1, 1)}
    assert benchmarks.bind(parsed, [], []).where("bound").count() == 0


def test_written_rules_and_catalogue(spark, tmp_path):
    parsed = benchmarks.parse(spark.createDataFrame([("f", TEXT)], "file string, text string"))
    benchmarks.write(benchmarks.bind(parsed, [xccdf.Binding.of(b) for b in OWN[:1]], []), f"file://{tmp_path}/out")
    lines = lambda name: [json.loads(x) for f in (tmp_path / "out" / name).glob("part-*") for x in f.read_text().splitlines()]
    assert [(r["id"], r["severity"], r["remediation"], r["rationale"]) for r in lines("rules")] == [("NET-1", "low", {"cisco_ios": ["no telnet"]}, "why")]
    assert sorted((r["vuln_id"], r["bound"], r["status"]) for r in lines("catalogue")) == [("V-1", True, "evaluated"), ("V-3", False, "manual review")]
    lost = benchmarks.bind(parsed, [xccdf.Binding("snmp.version == 3", "NET-1", remediation_from="none")], [])
    assert lost.where("bound").first().problem == "remediation of unknown rule none"
    with pytest.raises(Exception, match="unknown rule"):
        benchmarks.write(lost, f"file://{tmp_path}/lost")


def test_command_over_a_folder(spark, tmp_path, capsys):
    from plumbline import cli

    (tmp_path / "in").mkdir()
    for name, text in (("a.xml", TEXT), ("b.xml", TEXT[:-4])):
        (tmp_path / "in" / name).write_text(text)
    (tmp_path / "own.json").write_text(json.dumps({"bindings": OWN}))
    assert cli.main(["stig-import", str(tmp_path / "in"), "--bindings", str(tmp_path / "own.json"), "--out", str(tmp_path / "out")]) == 1
    assert "b.xml: not well-formed" in capsys.readouterr().out
    assert sum(len(f.read_text().splitlines()) for f in (tmp_path / "out" / "rules").glob("part-*")) == 2


def test_labels_like_the_plain_ones(spark):
    from plumbline.operators import validation

    docs = [{"config_id": "d", "ir_facts": {"a.b": {"value": v, "line": k}, "c": {"value": None}}, "expected_verdicts": {"R": "pass", "S": "unknown"}} for k, v in enumerate(["x, [y]", "[1]", True, 7, 1.5, [], ["a", "b"], [1, 2], ""])] + [{"config_id": "e"}, {"config_id": "f", "ir_facts": {}, "expected_verdicts": None}]
    facts, verdicts = validation.labels_of([(str(k), d) for k, d in enumerate(docs)])
    found = validation.labels(spark.createDataFrame([(str(k), json.dumps(d), 1) for k, d in enumerate(docs)], "file string, text string, name int"))
    assert sorted(map(str, (tuple(r) for r in validation.fact_labels(found).collect()))) == sorted(map(str, facts))
    assert sorted(tuple(r) for r in validation.verdict_labels(found).collect()) == sorted(verdicts)
    bad = [("a", None), ("b", ""), ("c", "[1]"), ("d", '{"config_id": ""}'), ("e", '{"config_id": "x", "ir_facts": {"p": {"line": 1}}, "expected_verdicts": {"R": "maybe", "S": null, "T": "pass"}}')]
    got = validation.labels(spark.createDataFrame(bad, "file string, text string"))
    assert sorted((r.file, r.error) for r in got.collect() if r.error) == [(f, "a label needs a config_id") for f in "abcd"] + [("e", "R can't be maybe"), ("e", "S can't be null"), ("e", "p needs a value")]
    assert [tuple(r) for r in validation.verdict_labels(got).collect()] == [("x", "T", "pass")] and validation.labels(spark.createDataFrame([], "file string, text string")).count() == 0
