"""Signatures: the standard's vectors, ledgers, packs, key files and the command line."""

from __future__ import annotations

import json
import os
import stat

import pytest
from pyspark.sql import functions as F

from plumbline import cli
from plumbline.catalog import QUERIES
from plumbline.functions import ed25519
from plumbline.operators import ledger, packs

#: Fixed: RFC 8032, 7.1: secret, public, message, signature.
VECTORS = [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
]


def test_vectors():
    for secret, public, message, signature in VECTORS:
        key = ed25519.SigningKey(bytes.fromhex(secret))
        assert key.public.hex() == public and key.sign(bytes.fromhex(message)).hex() == signature
    keys, messages, signatures = ([bytes.fromhex(v[k]) for v in VECTORS] for k in (1, 2, 3))
    assert list(ed25519.verify_all(messages, signatures, keys)) == [True, True]
    assert not ed25519.verify_all(messages[::-1], signatures, keys).any()


def test_bad_signatures_are_told_row_by_row():
    key = ed25519.SigningKey(bytes(32))
    good = key.sign(b"m")
    big = good[:32] + (int.from_bytes(good[32:], "little") + ed25519.ORDER).to_bytes(32, "little")  # the same point, but not the one form
    flipped = [good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :] for k in (0, 31, 32, 63)]
    rows = [good, big, b"", good[:63], None, *flipped]
    assert list(ed25519.verify_all([b"m"] * len(rows), rows, [key.public] * len(rows))) == [True] + [False] * (len(rows) - 1)
    assert not ed25519.verify_all([b"m", None, b"m"], [good] * 3, [b"\xff" * 32, key.public, None]).any()
    assert list(ed25519.verify_all([], [], [])) == [] and key.sign_all([]) == []


def test_many_rows_of_a_key_are_judged_like_single_ones():
    """A key of many rows has a table; beside it stand keys of few rows, points of small order and no points."""
    small = [bytes(32), (1).to_bytes(32, "little"), bytes.fromhex("26e8958fc2b227b045c3f489f2ef98f0d5dfac05d3c63339b13802886d53fc05")]
    key, other = ed25519.SigningKey(b"a" * 32), ed25519.SigningKey(b"b" * 32)
    rows = []
    for k in range(ed25519.MANY + 8):
        m = b"%d" % k
        rows.append((m, key.sign(m) if k % 3 else bytes(64), key.public, bool(k % 3)))
        rows += [(m, small[1] + bytes(32), small[k % 2], None), (m, small[1] + bytes(32), b"\xff" * 32, False), (m, small[1] + bytes(32), (2).to_bytes(32, "little"), False)]
        if not k % 9:
            rows += [(m, other.sign(m), other.public, True), (m, other.sign(m), key.public, False), (m, small[1] + bytes(32), small[2], None)]
    single = [bool(ed25519.verify_all([m], [s], [a])[0]) for m, s, a, _ in rows]
    assert list(ed25519.verify_all(*([r[i] for r in rows] for i in range(3)))) == single
    assert all(told in (None, got) for got, (*_, told) in zip(single, rows, strict=True)) and len({g for g, r in zip(single, rows, strict=True) if r[3] is None}) == 2


def test_tables_hold_multiples():
    scalars = ed25519._array([0, 1, 2, 255, 256, ed25519.ORDER - 1, ed25519.ORDER, 2**252 + 12345, 2**256 - 1])
    n = len(scalars)
    base = ed25519._base(n)
    ladder = ed25519._encoded(ed25519._twice(scalars % ed25519.ORDER, base, scalars * 0, base))
    assert ed25519._times_base(list(scalars)) == ladder
    assert ed25519._encoded(ed25519._plus(base, scalars, ed25519._base_multiples())) == ed25519._times_base([int(v) + 1 for v in scalars % ed25519.ORDER])
    for k in range(1, 10):
        z = ed25519._array([3**i for i in range(1, k + 1)])
        assert list(z * ed25519._inverted(z) % ed25519.P) == [1] * k


def test_a_small_file_is_signed_and_verified_once_on_all_cores(spark, tmp_path):
    spark.range(300).selectExpr("id AS s_suppkey", "'s' || id AS s_name").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    df = QUERIES["ledger_signatures"](spark, str(tmp_path))
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2  # one signs, one verifies
    assert df.select(F.spark_partition_id()).distinct().count() > 1
    case = lambda k: "unsigned" if k % 5 == 0 else "signed by a key that isn't known" if k % 7 == 0 else "the signature doesn't verify" if k % 3 == 0 else None
    assert sorted(map(tuple, df.collect())) == [(k, case(k)) for k in range(300) if case(k)]
    key = ed25519.SigningKey(b"a" * 32)
    report = {"timestamp": "t", "report_id": "r", "device_id": "d", "merkle_root": "0", "rule_set_digest": "x", "ir_schema_version": "1.0.0"}
    path = str(tmp_path / "ledger")
    ledger.record(spark, path, [report] * 20)
    told = ledger.unsigned(ledger.read(spark, path), {key.key_id: key.public})
    assert told.select(F.spark_partition_id()).distinct().count() > 1 and told.count() == 20


def test_entries_without_a_name_are_altered_too(spark, tmp_path):
    rows = [(3, None), (6, "s"), (1, None), (5, None), (7, None), (None, "s")]
    spark.createDataFrame(rows, "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(map(tuple, QUERIES["ledger_signatures"](spark, str(tmp_path)).collect()))
    assert got == [(3, "the signature doesn't verify"), (5, "unsigned"), (6, "the signature doesn't verify"), (7, "signed by a key that isn't known")]


def test_column(spark):
    key = ed25519.SigningKey(bytes(range(32)))
    messages = [f"é{k}".encode() for k in range(40)]
    rows = [(k, m, bytes(s) if k % 3 else bytes(64), key.public) for k, (m, s) in enumerate(zip(messages, key.sign_all(messages), strict=True))] + [(40, None, None, None)]
    df = spark.createDataFrame(rows, "k int, m binary, s binary, p binary").repartition(3)
    got = {r.k: r.v for r in df.select("k", ed25519.verified("m", "s", "p").alias("v")).collect()}
    assert got == {k: bool(k % 3) for k in range(40)} | {40: False}


def test_ledger(spark):
    key, other = ed25519.SigningKey(b"a" * 32), ed25519.SigningKey(b"b" * 32)
    report = lambda k: {"timestamp": "t", "report_id": f"r{k}", "device_id": 'd"é\\', "merkle_root": "0", "rule_set_digest": None, "ir_schema_version": "1.0.0"}
    first = ledger.append([], [report(k) for k in range(3)], key)
    rest = ledger.append(first, [report(3)], other) + []
    rest += ledger.append(rest, [report(4)])
    rows = [tuple(e[c.split()[0]] for c in ledger.ENTRY.split(", ")) for e in first + rest]
    df = spark.createDataFrame(rows, ledger.ENTRY)
    told = lambda d, keys: sorted((r.seq, r.problem) for r in ledger.verify(d, keys).collect())
    assert told(df, None) == []
    assert told(df, {key.key_id: key.public}) == [(4, "signed by a key that isn't known"), (5, "unsigned")]
    assert told(df, {key.key_id: key.public, other.key_id: other.public}) == [(5, "unsigned")]
    late = df.withColumn("timestamp", F.when(F.col("seq") == 5, "later").when(F.col("seq") == 4, "u").otherwise(F.col("timestamp"))).where("seq < 5")
    assert told(late, {key.key_id: key.public, other.key_id: other.public}) == [(4, "the signature doesn't verify")]  # the last one's chain can't show it
    assert told(df.limit(0), {}) == []
    hexless = df.where("seq = 1").withColumn("signature", F.lit("zz"))
    assert told(hexless, {key.key_id: key.public}) == [(1, "the signature doesn't verify")]


def test_packs(spark):
    key, other = ed25519.SigningKey(b"a" * 32), ed25519.SigningKey(b"b" * 32)
    pack = packs.Pack("p", "v", None, (packs.Mapping("aaa.enabled", "^aaa", "presence"),))
    signed = packs.from_document(json.loads(json.dumps(packs.document(pack.signed(key)))))
    keys = {key.key_id: key.public}
    assert signed == pack and signed.digest() == pack.digest() and packs.admit([signed], set(), keys) == [signed] and signed.signed_by(keys) == key.key_id
    altered = packs.document(signed) | {"vendor": "w"}
    swapped = packs.document(signed) | {"signature": packs.document(pack.signed(other))["signature"] | {"key_id": key.key_id}}
    for bad in (packs.from_document(altered), packs.from_document(swapped), pack.signed(other), pack):
        with pytest.raises(packs.PackError):
            packs.admit([signed, bad], set(), keys)
    with pytest.raises(packs.PackError):  # a trusted digest doesn't excuse a signature that fails
        packs.admit([packs.from_document(swapped)], {pack.digest()}, keys)
    assert packs.admit([pack], {pack.digest()}, keys) == [pack]
    with pytest.raises(packs.PackError):
        packs.from_document(packs.document(signed) | {"signature": {"algorithm": "none"}})


def test_files_and_commands(spark, tmp_path, capsys):
    path = str(tmp_path / "own.pem")
    assert cli.main(["keygen", path]) == 0
    key = ed25519.SigningKey.load(path)
    assert capsys.readouterr().out.strip() == key.key_id and stat.S_IMODE(os.stat(path).st_mode) == 0o600 and key.seed.hex() not in repr(key)
    with pytest.raises(FileExistsError):
        key.save(path)
    assert ed25519.load_public(str(tmp_path / "own.pub")) == key.public
    (tmp_path / "bad.pub").write_text("nothing")
    assert ed25519.trusted_keys(str(tmp_path)) == {key.key_id: key.public} and ed25519.trusted_keys(str(tmp_path / "none")) == {}
    with pytest.raises(ed25519.BadKey):
        ed25519.load_public(path)
    (tmp_path / "p.json").write_text(json.dumps({"id": "p", "vendor": "v", "mappings": [{"ir_path": "aaa.enabled", "match": "^aaa", "transform": "presence"}]}))
    assert cli.main(["pack", str(tmp_path / "p.json"), "--sign", path, "--out", str(tmp_path / "s.json")]) == 0
    assert packs.from_document(json.loads((tmp_path / "s.json").read_text())).signed_by({key.key_id: key.public})
    report = {"timestamp": "t", "report_id": "r", "device_id": "d", "merkle_root": "0", "rule_set_digest": "x", "ir_schema_version": "1.0.0"}
    ledger.record(spark, str(tmp_path / "ledger"), [report], key)
    assert cli.main(["verify", str(tmp_path / "ledger"), "--key", str(tmp_path / "own.pub")]) == 0
    ledger.record(spark, str(tmp_path / "ledger"), [report])
    capsys.readouterr()
    assert cli.main(["verify", str(tmp_path / "ledger"), "--key", str(tmp_path / "own.pub")]) == 1
    assert "entry 2: unsigned" in capsys.readouterr().out
