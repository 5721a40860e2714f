from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random

import pyarrow as pa
import pytest

from plumbline.llm import warc
from plumbline.llm.warc import archive, headers, member, read, read_file, record, round_trip


def pages(n=200, seed=5):
    rng = random.Random(seed)
    out = [(k, f"http://h{k % 7}.example/{k}", "é" * rng.randint(0, 3) + f"<p>{rng.randint(0, 60)}</p>" * rng.randint(0, 300)) for k in range(n)]
    return [*out, (n, None, None), (n + 1, "u\r\nx: y", ""), (n + 2, "z", "WARC/1.1\r\n\r\nWARC-Type: x"), (n + 2, "z", "WARC/1.1\r\n\r\nWARC-Type: x"), (None, "n", "alone"), (n + 3, "big", "ab" * 400_000)]


def want(rows):
    held = {}
    for p, _, h in rows:
        h = (h or "").encode()
        held[h] = max([x for x in (held.get(h), p) if x is not None], default=None)
    out = []
    for p, _, h in rows:
        h = (h or "").encode()
        top = held[h]
        revisit = top is not None and p != top
        out.append((p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_round_trip(spark):
    rows = pages()
    assert sorted(map(tuple, round_trip(frame(spark, rows)).collect()), key=str) == want(rows)


def test_payloads_come_back(spark, tmp_path):
    rows = pages(60)
    path = f"file://{tmp_path}/w"
    archive(frame(spark, rows), path)
    got = read(spark, path).collect()
    texts = {(p, (h or "").encode()) for p, _, h in rows}
    for r in got:
        if r.record_type == "response":
            assert (r.page_id, bytes(r.payload)) in texts and hashlib.sha1(r.payload).digest() == base64.b32decode(r.payload_digest)
        else:
            assert r.payload is None
    assert not [f for f in (tmp_path / "w").iterdir() if f.name.startswith("_pending")]
    # the members are plain gzip
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("*.warc.gz")))
    assert whole.count(b"\r\nWARC-Payload-Digest: ") == len(rows)


def test_predicates_are_pushed(spark, tmp_path):
    rows = pages(80)
    path = f"file://{tmp_path}/w"
    archive(frame(spark, rows), path)
    df = read(spark, path).where("record_type = 'revisit' and page_id >= 10 and target_uri like 'http://h1%'")
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, StringContains

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), StringContains(("target_uri",), "h")]))
    assert len(reader.tests) == 1 and [type(f) for f in left] == [StringContains]
    # what the reader yields already satisfies the predicate
    assert {t for part in reader.partitions() for batch in reader.read(part) for t in batch.column("record_type").to_pylist()} == {"revisit"}
    expected = [w for w in want(rows) if w[3] == "revisit" and (w[0] or 0) >= 10]
    by_id = {p: u for p, u, _ in rows}
    assert sorted(r.page_id for r in df.collect()) == sorted(w[0] for w in expected if (by_id[w[0]] or "").startswith("http://h1"))
    with pytest.raises(Exception):
        read(spark, f"file://{tmp_path}/nothing").collect()


def test_unwanted_payloads_are_not_inflated():
    blob = b"".join(member(record(k, "u", b"x" * 50_000, "response", None, "d")) for k in range(20))
    file = pa.BufferReader(blob)
    before = dict(warc.SEEN)
    got = list(read_file(file, lambda row: row["page_id"] == 7, True))
    assert [r["page_id"] for r in got] == [7] and got[0]["payload"] == b"x" * 50_000
    assert warc.SEEN["records"] - before["records"] == 20 and warc.SEEN["payloads"] - before["payloads"] == 1


def test_members_of_other_writers():
    texts = [record(k, "u" * 9000, bytes([65 + k]) * 30_000, "response", None, "d") for k in range(5)]
    packed = b"".join(gzip.compress(t) for t in texts)
    got = list(read_file(pa.BufferReader(packed), lambda row: row["page_id"] != 2, True))
    assert [(r["page_id"], r["payload"][:1]) for r in got] == [(0, b"A"), (1, b"B"), (3, b"D"), (4, b"E")]
    assert headers(b"WARC/1.1\r\nA: b") is None
    with pytest.raises(ValueError):
        list(read_file(pa.BufferReader(packed[:100]), lambda row: True, True))
    with pytest.raises(ValueError):
        list(read_file(pa.BufferReader(io.BytesIO(b"plain text that is no archive").getvalue()), lambda row: True, True))


def test_small_payloads_and_empty_table(spark):
    rows = [(1, "a", "x"), (2, "b", "x"), (3, "c", "xx"), (4, "d", "xx")]
    got = {r.page_id: r.record_type for r in round_trip(frame(spark, rows), least=2).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert round_trip(frame(spark, [])).count() == 0


def test_plain_archives_and_foreign_records(spark, tmp_path):
    rows = [record(k, "u", b"WARC/1.1\r\n\r\n" * k + b"x" * 30_000 * k, "revisit" if k == 2 else "response", 1 if k == 2 else None, "d") for k in range(5)]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields\r\nContent-Length: 7\r\n\r\na: b\r\n\n\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(info + b"".join(rows))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in [info, *rows]))
    got = read(spark, f"file://{tmp_path}").collect()
    seen = sorted((str(r.page_id), r.record_type, r.payload_bytes, None if r.payload is None else len(r.payload)) for r in got)
    sizes = [len(b"WARC/1.1\r\n\r\n" * k + b"x" * 30_000 * k) for k in range(5)]
    one = [("None", "warcinfo", 7, None)] + [(str(k), "revisit" if k == 2 else "response", sizes[k], None if k == 2 else sizes[k]) for k in range(5)]
    assert seen == sorted(one * 2, key=lambda r: (r[0], r[1]))
    with pytest.raises(ValueError):
        list(read_file(pa.BufferReader((info + b"".join(rows))[:-9000]), lambda row: True, True))


@pytest.mark.parametrize("pack", [member, gzip.compress])
def test_large_files_are_split_between_members(pack, monkeypatch):
    rng = random.Random(2)
    blob = b"".join(pack(record(k, "u", bytes(rng.randrange(256) for _ in range(rng.randrange(3000))), "response", None, "d")) for k in range(60))
    file = pa.BufferReader(blob)
    edges = [0, 1, 777, 20_000, 20_001, 45_000, len(blob)]
    found = [[r["page_id"] for r in read_file(file, lambda row: True, True, a, b)] for a, b in zip(edges, edges[1:], strict=False)]
    assert [p for part in found for p in part] == list(range(60)) and found[0] == [0]


def test_ranges_of_large_files(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PARTITION_BYTES", 1000)
    (tmp_path / "a.warc.gz").write_bytes(b"0" * 4500)
    (tmp_path / "b.warc.gz").write_bytes(b"0" * 300)
    (tmp_path / "c.warc").write_bytes(b"0" * 4500)
    parts = [p.ranges for p in warc.WarcReader({"path": str(tmp_path)}).partitions()]
    ranges = [(p.rsplit("/", 1)[1], a, b) for part in parts for p, a, b in part]
    assert ranges == [*(("a.warc.gz", k, min(4500, k + 1000)) for k in range(0, 4500, 1000)), ("b.warc.gz", 0, None), ("c.warc", 0, None)]


def test_clashing_columns(spark):
    rows = [(1, "a", "x", "y", b"z"), (2, "b", "x", None, None)]
    got = round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, record_type string, payload binary")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "revisit", 2), (2, "response", None)]
