from __future__ import annotations

import hashlib
import hmac
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as s
from plumbline.operators import packs
from plumbline.plans import rules
from plumbline.sources import bundle, xccdf


def column(spark, values, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string")
    return [r.y for r in df.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_redaction(spark):
    lines = ["username a secret 9 $9$xyz", "snmp-server community hush RO", "set community read cipher abc", "key 7 0xA", 'psk=abc other=1', "no secrets", None]
    got = column(spark, lines, s.redact)
    assert got == ["username a secret 9 <redacted>", "snmp-server community <redacted> RO", "set community read cipher <redacted>", "key 7 <redacted>", "psk=<redacted> other=1", "no secrets", None]
    assert column(spark, ["set name hush"], lambda c: s.redact_literal(c, F.lit("hush"))) == ["set name <redacted>"]


def test_masks_and_addresses(spark):
    assert column(spark, ["255.255.255.0", "255.0.255.0", "0.0.0.0", "x", "255.255.255.255"], s.mask_prefix) == [24, None, 0, None, 32]
    assert column(spark, ["0.0.0.255", "255.255.255.255", "x"], s.wildcard_prefix) == [24, 0, 32]
    assert column(spark, ["10.0.0.1", "256.0.0.1", None], s.ipv4_number) == [167772161, None, None]


def test_small_functions(spark):
    assert column(spark, ["yes", "OFF", "1", "maybe", '"enable"'], s.to_bool) == [True, False, True, None, True]
    assert column(spark, ["eq ssh", "eq 22", "20-25", "gt 5", "www-443"], lambda c: s.port_matches(c, F.lit(22))) == [True, True, True, False, False]
    assert column(spark, ["ntp server 10.0.0.1", "a=b C", "User 'x' 5"], s.line_shape) == ["ntp server *", "a=* c", "user * *"]
    assert column(spark, ["10.1.1.1", "a@b.cc", "plain words"], s.customer_data) == ["an IPv4 address", "an email address", None]
    assert column(spark, ["90", "60", "x"], lambda c: s.transform("minutes_from_seconds", c)) == ["2", "1", None]
    assert column(spark, ["On", "x"], lambda c: s.transform("lookup", c, {"on": "5"})) == ["5", None]
    with pytest.raises(ValueError):
        s.transform("nope", F.lit("x"))


def test_hashes(spark):
    key = b"k" * 80
    assert column(spark, ["msg", "é"], lambda c: s.hmac_sha256(key, c)) == [hmac.new(key, m.encode(), hashlib.sha256).hexdigest() for m in ("msg", "é")]
    assert column(spark, ["{}"], s.leaf_hash) == [hashlib.sha256(b"\0{}").hexdigest()]


def test_lines_and_bundles(spark):
    df = spark.createDataFrame([("d", "f", "config", "a\r\n  b\x0bc d\n"), ("e", "f", "config", ""), ("n", "f", "config", None)], "device_id string, file string, role string, text string")
    assert [(r.line_no, r.raw, r.text, r.indent) for r in bundle.lines(df).orderBy("line_no").where("device_id = 'd'").collect()] == [(1, "a", "a", 0), (2, "  b", "b", 2), (3, "c", "c", 0), (4, "d", "d", 0)]
    assert bundle.lines(df).where("device_id = 'n'").count() == 0
    raw = spark.createDataFrame([("core.cfg", b"\xef\xbb\xbfhostname x"), ("core.show-version.txt", b"caf\xe9"), ("pic.png", b"x"), ("edge.conf", b"y")], "path string, content binary")
    got = {r.file: (r.device_id, r.role, r.text) for r in bundle.source_files(raw).collect()}
    assert got == {"core.cfg": ("core", "config", "hostname x"), "core.show-version.txt": ("core", "show_output", "café"), "edge.conf": ("edge", "config", "y")}


def test_unsafe_archives(tmp_path):
    for name in ("../x.cfg", "/x.cfg", "a/../../x.cfg"):
        path = tmp_path / "z.zip"
        with zipfile.ZipFile(path, "w") as z:
            z.writestr(name, "x")
        with pytest.raises(bundle.BundleError):
            bundle.check_archive(str(path))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("bomb.cfg", "0" * 5_000_000)
    with pytest.raises(bundle.BundleError):
        bundle.check_archive(str(path))


def test_grammars(spark):
    texts = {"brace": "a {\n b;\n}\n", "flat": "/ip x set a=b\n/ip y add c=d\n", "indent": "int a\n desc b\n!\n", "marker": "sys\n#\nint\n ip\n#\n", "none": "one two\nthree\n", "xml": "<?xml?>\n<a></a>\n"}
    df = spark.createDataFrame([(k, "f", "config", v) for k, v in texts.items()], "device_id string, file string, role string, text string")
    got = {r.device_id: r.grammar for r in packs.grammar(bundle.lines(df)).collect()}
    assert got == {"brace": "brace", "flat": "flat", "indent": "indent", "marker": "marker", "none": "unknown", "xml": "xml"}
    tree = {r.text: list(r.context) for r in packs.tree(bundle.lines(df).where("device_id = 'indent'")).collect()}
    assert tree["desc b"] == ["int a"] and tree["int a"] == []
    deep = spark.createDataFrame([("d", "f", "config", "a\n  b\n    c\n  d\n e\n   f\ng\n")], "device_id string, file string, role string, text string")
    assert {r.text: list(r.context) for r in packs.tree(bundle.lines(deep)).collect()} == {"a": [], "b": ["a"], "c": ["a", "b"], "d": ["a"], "e": ["a"], "f": ["a", "e"], "g": []}


BENCH = """<Benchmark xmlns="http://checklists.nist.gov/xccdf/1.2"><Group id="V-1"><Rule id="SV-1" severity="high"><version>NET-1</version><title>T</title>
<description>&lt;VulnDiscussion&gt;why&lt;/VulnDiscussion&gt;</description><ident system="http://cyber.mil/cci">CCI-1</ident><fixtext>do it</fixtext></Rule></Group>
<Group id="V-2"><Rule id="SV-2" severity="odd"><version>NET-2</version><title>U</title></Rule></Group></Benchmark>"""


def test_benchmarks(spark):
    rows = xccdf.controls(BENCH)
    assert rows[0] == ("V-1", "SV-1", "NET-1", "T", "critical", ["CCI-1"], "why", "do it") and rows[1][4] == "info"
    made, manual = xccdf.bind(rows, [xccdf.Binding.of({"assert": "mgmt.telnet_enabled == false", "stig_id": "net-1"})], rules.SHIPPED)
    assert [r.id for r in made] == ["NET-1"] and [m[0] for m in manual] == ["V-2"]
    assert {r.severity: (r.controls, r.checked) for r in xccdf.counts(xccdf.benchmark(spark, BENCH), ["NET-1"]).collect()} == {"critical": (1, 1), "info": (1, 0)}
    for bad in ("<!DOCTYPE x><Benchmark/>", "<Benchmark>", "<Benchmark/>"):
        with pytest.raises(rules.RuleError):
            xccdf.controls(bad)


def test_import_of_a_benchmark(spark, tmp_path):
    import json

    from plumbline import cli

    (tmp_path / "b.xml").write_text(BENCH)
    own = {"bindings": [{"vuln_id": "v-1", "assert": "mgmt.telnet_enabled == false", "remediation": {"cisco_ios": ["no telnet"]}, "frameworks": ["OWN:1"], "applies_to": {"vendor": ["cisco"]}, "severity": "LOW"}, {"stig_id": "NET-1", "assert": "mgmt.http_enabled == false"}]}
    (tmp_path / "own.json").write_text(json.dumps(own))
    assert cli.main(["stig-import", str(tmp_path / "b.xml"), "--bindings", str(tmp_path / "own.json"), "--out", str(tmp_path / "out")]) == 0
    made = rules.from_documents([("rules.json", json.loads((tmp_path / "out" / "rules.json").read_text()))])
    assert made == [rules.Rule("NET-1", "low", "mgmt.telnet_enabled == false", "T", ("STIG:NET-1", "STIG-VULN:V-1", "CCI:CCI-1", "OWN:1"), "why", {"cisco_ios": ("no telnet",)}, ("cisco",))]
    assert rules.families(made) == ["CCI", "DISA-STIG", "OWN"]
    listed = json.loads((tmp_path / "out" / "catalogue.json").read_text())
    assert [(c["vuln_id"], c["bound"], c["status"], c.get("rule")) for c in listed] == [("V-1", True, "evaluated", "NET-1"), ("V-2", False, "manual review", None)]
    for bad in ([], {"bindings": {}}, {"bindings": [{"assert": "x"}]}, {"bindings": ["x"]}):
        with pytest.raises(rules.RuleError):
            xccdf.bindings(bad)
    with pytest.raises(rules.RuleError):
        xccdf.bind(xccdf.controls(BENCH), [xccdf.Binding("mgmt.telnet_enabled == false", "NET-1", remediation_from="none")], rules.SHIPPED)
    assert rules.from_documents([("x.json", rules.to_documents(rules.SHIPPED))]) == sorted(rules.SHIPPED, key=lambda r: r.id)


def test_rules_as_documents():
    raw = {"id": "A", "title": "t", "frameworks": ["STIG-1", "NIST:AC"], "severity": "high", "assert": "a.b == 1", "rationale": "r", "remediation": {}}
    got = rules.from_documents([("x.yaml", [raw]), ("_skip.yaml", [{}]), ("_template/y.yaml", [{}])])
    assert [r.id for r in got] == ["A"] and rules.families(got) == ["DISA-STIG", "NIST"] and rules.for_framework(got, "nist") == got
    for documents in ([], [("x", [{}])], [("x", [raw, raw])], [("x", [raw | {"assert": "a =="}])], [("x", [raw | {"severity": "x"}])]):
        with pytest.raises(ValueError):
            rules.from_documents(documents)


def test_stream_of_files(spark, tmp_path):
    from plumbline.streaming import watch
    from tests.fleet_configs import ROUTEROS

    (tmp_path / "in" / "r1").mkdir(parents=True)
    (tmp_path / "in" / "r1" / "export.rsc").write_text(ROUTEROS)
    for _ in range(2):
        watch.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "findings")).count() == 13


def _tree(spark, text):
    df = spark.createDataFrame([("d", "f", "config", text)], "device_id string, file string, role string, text string")
    rows = packs.tree(bundle.lines(df)).orderBy("line_no").collect()
    return [(r.text, r.kind, r.depth, list(r.context)) for r in rows]


def test_structure_of_every_grammar(spark):
    assert _tree(spark, "a {\n  b c {\n    x;\n\n    # n\n  }\n  y;\n}\n}\nz;\n") == [
        ("a {", "block_open", 0, []), ("b c {", "block_open", 1, ["a"]), ("x;", "statement", 2, ["a", "b c"]), ("", "blank", 2, []), ("# n", "comment", 2, []),
        ("}", "block_close", 1, []), ("y;", "statement", 1, ["a"]), ("}", "block_close", 0, []), ("}", "block_close", 0, []), ("z;", "statement", 0, []),
    ]
    assert _tree(spark, "#\ninterface 1\n ip x\n  more\n#\n left\nquit\nquit\n") == [
        ("#", "separator", 0, []), ("interface 1", "block_open", 0, []), ("ip x", "block_open", 1, ["interface 1"]), ("more", "statement", 2, ["interface 1", "ip x"]),
        ("#", "separator", 0, []), ("left", "statement", 0, []), ("quit", "block_close", 0, []), ("quit", "statement", 0, []),
    ]
    assert _tree(spark, "line vty\n login\nexit\n!\n other\n") == [("line vty", "block_open", 0, []), ("login", "statement", 1, ["line vty"]), ("exit", "block_close", 0, []), ("!", "separator", 0, []), ("other", "statement", 0, [])]
    assert _tree(spark, "/ip service set telnet\n/odd\nset system host-name x\n/a b add c=d\n") == [
        ("/ip service set telnet", "statement", 0, ["/ip service"]), ("/odd", "statement", 0, []), ("set system host-name x", "statement", 0, ["set system host-name"]), ("/a b add c=d", "statement", 0, ["/a b"]),
    ]
    assert {k for _, k, d, c in _tree(spark, '{"a": 1,\n "b": [\n  2]}\n')} == {"statement"}
    assert _tree(spark, "{\n a;\n}\n")[1][3] == [""]


def test_structure_of_any_depth(spark):
    import random

    rng = random.Random(4)
    indents = list(range(40)) + [rng.randint(0, 60) for _ in range(400)]
    text = "\n".join(" " * n + f"w{k}" for k, n in enumerate(indents))
    got = {t: c for t, _, _, c in _tree(spark, text)}
    for k, n in enumerate(indents):
        above, low = [], n
        for j in range(k - 1, -1, -1):
            if indents[j] < low:
                above.insert(0, f"w{j}")
                low = indents[j]
        assert got[f"w{k}"] == above
    braces = "".join(f"{' ' * (k % 3)}b{k} {{\n" for k in range(45)) + "x;\n" + "}\n" * 45
    assert _tree(spark, braces)[45] == ("x;", "statement", 45, [f"b{k}" for k in range(45)])


def test_blocks_of_mappings_are_any_around(spark):
    text = "top one\n middle\n  low 5\nother\n low 6\n"
    lines = bundle.lines(spark.createDataFrame([("d", "f", "config", text)], "device_id string, file string, role string, text string"))
    devices = spark.createDataFrame([("d", "v", None)], "device_id string, vendor string, os string")
    for block, read in (("^top", 3), ("^middle", 3), ("^other", 5)):
        pack = packs.Pack("p", "v", None, (packs.Mapping("mgmt.idle_timeout_min", r"^low (?P<value>\d+)", "to_int", within=block),))
        assert [r.line_no for r in packs.apply(lines, devices, [pack]).collect()] == [read]
