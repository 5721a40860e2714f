from __future__ import annotations

import random
import re

from plumbline.operators import anchors, packs
from plumbline.operators.packs import Mapping, Pack

LINES = "device_id string, file string, line_no int, text string, context array<string>"
DEVICES = "device_id string, vendor string, os string"


def keys(text):
    low = "".join(c.lower() if c.isascii() else c for c in text)
    return {"w:" + w for w in re.findall("[a-z0-9]+", low)} | {"t:" + low[k : k + 3] for k in range(max(len(low) - 2, 0))} | {""}


def test_keys_of_patterns():
    one = lambda p: set(anchors.keys_of([p])[0])
    assert one(r"^ip ssh version (?P<value>\d+)") == {"w:version"}
    assert one(r"telnet") == {"t:eln"} and one(r"\btelnet\b") == {"w:telnet"} and one(r"(?i)^TELNET\s+(\w+)$") == {"w:telnet"}
    assert one(r"^(?:no|undo) (\S+)") == {"w:no", "w:undo"}
    assert one(r"^a\s*b$") == {""}
    assert one(r"(?:abc)?x*") == {""} and one(r"[a[b]]xyz") == {""} and one(r"^(\S+)$") == {""}
    assert one(r"^ssh[0-9]* on$") == {"w:on"} and one(r"^port(?:=|\s+)(\d+)") == {"t:ort"}


def test_every_match_shares_a_key():
    rng = random.Random(11)
    pieces = ["ssh", "Telnet ", r"\s+", r"\s*", r"\b", "^", "$", "(?:on|off)", "(?:on|)", "[ab]", "[^a]", r"\d+", ".*", "x?", "(?P<value>" + r"\S+)", "no ", "=", "(?:ab)+", "-", "k", "ſ", r"\W", "_"]
    words = ["ssh", "Telnet", "TELNET", "telnet", "on", "off", "a", "b", "ab", "abab", "7", "12", "x", "no", "=", "-", " ", "  ", "k", "K", "ſ", "İ", "_", "\t"]
    hits = 0
    for _ in range(6000):
        p = "".join(rng.sample(pieces, rng.randint(1, 5)))
        if rng.random() < 0.4:
            p = "(?i)" + p
        try:
            compiled = re.compile(p, re.ASCII)
        except re.error:
            continue
        sets = anchors.required(p)
        for _ in range(40):
            text = "".join(rng.choice(words) for _ in range(rng.randint(1, 7)))
            if compiled.search(text):
                hits += 1
                assert all(s & keys(text) for s in sets), (p, text, sets)
    assert hits > 5000


def rows(spark, lines, devices=(("d", "v", "o"), ("e", "v", None), ("f", "w", "o"))):
    df = spark.createDataFrame([(d, "f", k, t, c) for d, _, _ in devices for k, (t, c) in enumerate(lines)], LINES)
    return df, spark.createDataFrame(list(devices), DEVICES)


def test_index_reads_what_the_conditional_reads(spark):
    rng = random.Random(5)
    words = ["ip", "ssh", "server", "Telnet", "no", "undo", "enable", "yes", "5", "900", "x", "log", "host7"]
    text = lambda n: rng.choice([" ", "  ", "=", ""]).join(rng.choice(words) for _ in range(rng.randint(1, n)))
    lines = [(text(5), [text(2) for _ in range(rng.randint(0, 3))] if rng.random() < 0.9 else None) for _ in range(300)] + [("", []), ("ſsh", []), ("SSH " * 500, [])]
    heads = ["^", r"\b", "", "(?i)", "(?i)^", "^(?:no|undo) "]
    tails = ["", r"\s+(?P<value>\S+)", r" (?P<value>\d+)$", r"=(?P<value>\w+)", ".*(?P<value>yes|no)"]
    made = []
    for k in range(80):
        kind = rng.choice(["identity", "to_int", "to_bool", "invert_yes_no", "minutes_from_seconds", "presence", "negated_presence", "collect_redacted", "lookup", "collect"])
        path = {"to_int": "mgmt.idle_timeout_min", "minutes_from_seconds": "mgmt.idle_timeout_min", "collect": "ntp.servers", "collect_redacted": "snmp.communities"}.get(kind, rng.choice(["logging.level", "mgmt.telnet_enabled", "device.model"]))
        made.append(Mapping(path, rng.choice(heads) + rng.choice(words) + rng.choice(tails), kind, 2 + k % 2, k / 100, rng.choice([None, None, "^ip", "ssh|log"]), {"YES": "a", "yes": "b", "5": "c"}))
    made.append(Mapping("logging.level", r"^(?P<value>\S+)\s\S+$", "identity"))
    split = [Pack("one", "v", None, tuple(made[:35])), Pack("two", "v", "o", tuple(made[35:])), Pack("three", "w", "other", tuple(made))]
    df, devices = rows(spark, lines)
    joined = df.where("text <> ''").join(devices, "device_id")
    plain = lambda found: sorted(map(str, found.select("device_id", "file", "line_no", "f.*").collect()))
    want = plain(packs.first_in_turn(joined, split))
    assert len(want) > 100 and plain(packs.first_by_index(joined, split)) == want
    packs_bytes, packs.INDEX_BYTES = packs.INDEX_BYTES, 0
    try:  # beyond the broadcast's bound: the same facts
        assert plain(packs.first_by_index(joined, split)) == want
    finally:
        packs.INDEX_BYTES = packs_bytes


def test_plan_does_not_grow_with_the_mappings(spark):
    df, devices = rows(spark, [("feature7 level 5", []), ("feature4999 level x", []), ("feature level 5", []), ("Feature7 level 5", [])], [("d", "v", None)])
    size = []
    for n in (100, 5000):
        pack = Pack("p", "v", None, tuple(Mapping("mgmt.idle_timeout_min", rf"^feature{k} level (?P<value>\d+)", "to_int") for k in range(n)))
        assert {len(k) for k in anchors.keys_of([m.match for m in pack.mappings])} == {1}
        got = packs.apply(df, devices, [pack])
        size.append(len(got._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        assert [(r.line_no, r.value) for r in got.collect()] == [(0, "5")]
    assert size[0] == size[1]


def test_nothing_to_read(spark):
    df, devices = rows(spark, [("a", [])])
    many = Pack("p", "v", None, tuple(Mapping("aaa.enabled", f"^w{k}$", "presence") for k in range(packs.FEW + 1)))
    assert packs.apply(df.limit(0), devices, [many]).count() == 0 and packs.apply(df, devices.limit(0), [many]).count() == 0
    assert packs.apply(df, devices, []).count() == 0 and packs.apply(df, devices, [many]).count() == 0


def test_packs_of_a_registry_like_admit(spark):
    import json

    from plumbline.functions.ed25519 import SigningKey

    key, other = SigningKey.generate(), SigningKey.generate()
    one = Pack("one", "v", None, (Mapping("aaa.enabled", "^aaa", "presence", 2, 0.87654),), (("^x", 0.5),))
    leaky = Pack("leaky", "v", None, (Mapping("aaa.enabled", "^ntp 10.0.0.1", "presence"),))
    named = {"trusted": one, "signed": one.signed(key), "stranger": Pack("two", "v", None, one.mappings).signed(other), "plain": Pack("three", "v", None, ()), "leaky": leaky}
    files = [(k, json.dumps(packs.document(p)), k) for k, p in named.items()] + [("null", None, ""), ("empty", "", ""), ("list", "[]", ""), ("bare", "{}", ""), ("odd", json.dumps(packs.document(one) | {"mappings": [{"ir_path": "aaa.enabled", "match": "x", "transform": "none"}]}), "")]
    df = spark.createDataFrame(files, "file string, text string, id string")
    got = {r.file: r for r in packs.checked(df, {one.digest(), leaky.digest()}, {key.key_id: key.public}).collect()}
    assert {k for k, r in got.items() if r.admitted} == {"trusted", "signed"} and got["signed"].digest == one.digest() == got["trusted"].digest
    assert all(r.problem for k, r in got.items() if not r.admitted) and len(got) == len(files)
    assert "isn't trusted" in got["stranger"].problem and "holds" in got["leaky"].problem
    assert packs.checked(df.limit(0), set()).count() == 0


def test_tables_like_lists(spark):
    import pytest
    from pyspark.sql import functions as F

    from plumbline.operators import learning
    from plumbline.plans import rules

    table = rules.project(rules.SHIPPED, spark)
    rows = spark.createDataFrame([("s", r.id, r.severity, r.assertion, r.probe, list(r.frameworks)) for r in rules.SHIPPED] + [("t", "R", "low", 'a == "ü\\n"', None, [])], "rule_set string, rule_id string, severity string, assertion string, probe string, frameworks array<string>")
    sums = {r.rule_set: r for r in rules.digests(rows, "rule_set").collect()}
    assert sums["s"].digest == rules.digest(rules.SHIPPED) and sums["s"].verifiable == table.where("verifiable").count()
    assert sums["t"].digest == rules.digest([rules.Rule("R", "low", 'a == "ü\\n"')])
    assert sorted(r.family for r in rules.families_of(rows, "rule_set").collect()) == rules.families(rules.SHIPPED)
    assert sorted(r.rule_id for r in rules.of_framework(rows, "nist-SP800-53:ac").collect()) == sorted(r.id for r in rules.for_framework(rules.SHIPPED, "nist-sp800-53:ac"))
    held = [Mapping("aaa.enabled", p, "presence") for p in (r"^telnet\s+server\s+(?P<value>\S+)", r"^ssh\s+(?P<value>\S+)", r"^idle-timeout\s+\d+", r"^telnet\s+server\s+x", "loose", r"^/a/b", "^c", "^d", "^e")]
    made = spark.createDataFrame([("p", k, m.match) for k, m in enumerate(held)] + [("q", 0, "^x"), ("r", 0, "loose")], "pack string, place int, match string")
    got = learning.fingerprints(made).collect()
    assert {(r.pattern, r.confidence) for r in got if r.pack == "p"} == set(learning.fingerprint(held)) and {r.pack for r in got} == {"p", "q"}
    why = spark.createDataFrame([("(a+)+",), ("^x",), (None,), ("[",), ("10.0.0.1",), ("a" * 401,)], "p string").select(packs.refusals(F.col("p")).alias("w")).collect()
    assert [r.w is None for r in why] == [False, True, True, False, False, False]
    with pytest.raises(packs.PackError):
        Mapping("aaa.enabled", "^x", "none").check()
