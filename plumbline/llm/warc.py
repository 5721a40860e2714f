"""WARC archives as a Spark data source, for reading and writing.

Files that are written hold one gzip member per record.  A member's extra field ``sl`` gives its
compressed and its inflated length, so a reader seeks past records that it doesn't want; members of
other writers, which lack the field, are inflated and dropped.  Plain archives (``.warc``) are read by
their records' lengths.  The reader plans partitions over files and over ranges of large packed ones
(a record belongs to the range in which its member begins; a member's start is told by its magic and by
inflating to a record's first bytes), inflates the first kilobytes of a record, parses its headers,
tests the pushed predicates on record type and headers, and inflates the payload only of records that
pass, and only if payloads are asked for.  A payload's length comes from the lengths that the standard
has: of the record less its HTTP head, and of a revisit what its HTTP head says.

Writers put files in a pending folder; the commit moves those of the tasks that succeeded, so lost
executors and repeated tasks leave nothing behind.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from plumbline.llm.common import scratch_dir, written

FILE_BYTES = 64 << 20
PARTITION_BYTES = 64 << 20
HEAD = 4096
ROWS = 512

SCHEMA = "page_id long, record_id string, record_type string, target_uri string, warc_date string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_ARROW = pa.schema(
    [
        ("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ]
)
_ID = "urn:page:"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or of a local path."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def member(block: bytes, level: int = 3) -> bytes:
    """One gzip member with its lengths in the extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(block) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(block))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str) -> bytes:
    """The text of a record; a revisit keeps the headers and drops the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{'' if refers_to is None else refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str] | None:
    """Lower-case names and values, or None if the record's head isn't whole."""
    end = head.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = head[:end].decode("utf-8", "replace").split("\r\n")
    out = {"": lines[0], " end": str(end + 4)}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _page(value: str | None) -> int | None:
    text = (value or "").strip("<>").removeprefix(_ID)
    return int(text) if text.lstrip("-").isdigit() else None


def payload_length(h: dict[str, str], after: bytes) -> int | None:
    """Bytes of the payload: what the record holds behind its HTTP head, or what a revisit's head says.

    ``after`` is the beginning of the record's block; None if it doesn't tell."""
    held = int(h["content-length"]) if h.get("content-length", "").isdigit() else None
    if "application/http" not in h.get("content-type", ""):
        return held
    http = headers(after)
    if http is None:
        return None
    if h.get("warc-type") == "revisit":
        return int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    return None if held is None else held - int(http[" end"])


def fields(h: dict[str, str], length: int | None = None) -> dict:
    """The columns that headers give."""
    return {
        "page_id": _page(h.get("warc-record-id")),
        "record_id": h.get("warc-record-id", "").strip("<>"),
        "record_type": h.get("warc-type"),
        "target_uri": h.get("warc-target-uri"),
        "warc_date": h.get("warc-date"),
        "payload_bytes": length,
        "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "refers_to": _page(h.get("warc-refers-to")) if "warc-refers-to" in h else None,
    }


#: Records read, records whose payload was inflated: for tests, in this process.
SEEN = {"records": 0, "payloads": 0}


class _Packed:
    """The gzip member of one record, inflated only as far as it is asked for."""

    def __init__(self, file, at: int):
        file.seek(at)
        start = file.read(HEAD)
        if len(start) < 18 or start[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at {at}")
        self.file, self.at, self.skip = file, at, 0
        if start[3] & 4:
            (extra,) = struct.unpack_from("<H", start, 10)
            if start[12:14] == b"sl" and extra >= 12:
                (self.skip,) = struct.unpack_from("<I", start, 16)
        self.machine = zlib.decompressobj(31)
        self.text = self.machine.decompress(start, HEAD * 4)
        self.left, self.read = self.machine.unconsumed_tail, len(start)

    def more(self, size: int, most: int = 0) -> bool:
        """Inflate on; false at the member's end."""
        if self.machine.eof:
            return False
        data = self.left or self.file.read(size)
        if not data:
            raise ValueError(f"the record at {self.at} is cut off")
        if not self.left:
            self.read += len(data)
        self.text += self.machine.decompress(data, most)
        self.left = self.machine.unconsumed_tail
        return True

    def whole(self) -> bytes:
        parts = [self.text]
        self.text = b""
        while self.more(1 << 16):
            parts.append(self.text)
            self.text = b""
        self.text = b"".join(parts)
        return self.text

    def next(self, block_end: int | None) -> int:
        """Where the next member begins; members without lengths are inflated for that."""
        if self.skip:
            return self.at + self.skip
        while self.more(1 << 16):
            self.text = b""
        return self.at + self.read - len(self.machine.unused_data)


class _Plain:
    """A record of an archive that isn't packed."""

    def __init__(self, file, at: int):
        file.seek(at)
        self.file, self.at = file, at
        self.text = file.read(HEAD * 4)
        if not self.text.startswith(b"WARC/"):
            raise ValueError(f"no record at {at}")

    def more(self, size: int, most: int = 0) -> bool:
        data = self.file.read(size)
        self.text += data
        return bool(data)

    def upto(self, end: int) -> bytes:
        if end > len(self.text):
            self.text += self.file.read(end - len(self.text))
        if end > len(self.text):
            raise ValueError(f"the record at {self.at} is cut off")
        return self.text

    def next(self, block_end: int | None) -> int:
        if block_end is None:
            raise ValueError(f"the record at {self.at} has no length")
        return self.at + block_end + 4


def first_member(file, start: int, end: int) -> int:
    """The first place in [start, end) where a member begins that inflates to a record; else end."""
    at, keep = start, b""
    while at < end:
        file.seek(at)
        data = file.read(1 << 20)
        if not data:
            return end
        hit = data.find(b"\x1f\x8b\x08")
        while hit >= 0 and at + hit < end:
            file.seek(at + hit)
            try:
                if zlib.decompressobj(31).decompress(file.read(HEAD), 5) == b"WARC/":
                    return at + hit
            except zlib.error:
                pass
            hit = data.find(b"\x1f\x8b\x08", hit + 1)
        at += max(1, len(data) - 2)
    return end


def read_file(file, wanted, payloads: bool, start: int = 0, end: int | None = None) -> Iterator[dict]:
    """Records of an open file that begin in [start, end) and that ``wanted(fields)`` accepts."""
    size = file.size()
    end = size if end is None else min(end, size)
    file.seek(0)
    plain = file.read(5) == b"WARC/"
    at = start if plain or not start else first_member(file, start, end)
    while at < end:
        record = _Plain(file, at) if plain else _Packed(file, at)
        found = headers(record.text)
        while found is None and record.more(HEAD, HEAD * 4):
            found = headers(record.text)
        SEEN["records"] += 1
        body_at = int(found[" end"]) if found else 0
        block = int(found["content-length"]) if found and found.get("content-length", "").isdigit() else None
        length = None
        if found:
            # the HTTP head tells the payload's length; only a very long one takes more reading
            most = body_at + (1 << 20 if block is None else block)
            while "application/http" in found.get("content-type", "") and b"\r\n\r\n" not in record.text[body_at:most] and len(record.text) < most:
                if not record.more(HEAD, HEAD * 4):
                    break
            length = payload_length(found, record.text[body_at:most])
        row = fields(found or {}, length)
        accepted = found is not None and wanted(row)
        inflate = accepted and payloads and row["record_type"] == "response"
        if accepted and not inflate:
            yield row | {"payload": None}
        if inflate:
            SEEN["payloads"] += 1
            text = record.upto(body_at + block) if plain and block is not None else record.whole() if not plain else record.text
            whole = text[body_at : body_at + block] if block is not None else text[body_at:]
            payload = whole.partition(b"\r\n\r\n")[2] if "application/http" in found.get("content-type", "") else whole
            yield row | {"payload": payload}
        at = record.next(None if block is None else body_at + block)


class Files(InputPartition):
    """Ranges (path, first byte, last byte + 1) of files; a whole file's range ends at None."""

    def __init__(self, ranges: list):
        self.ranges = ranges


_TESTS = {
    EqualTo: lambda x, v: x is not None and x == v,
    EqualNullSafe: lambda x, v: x == v,
    In: lambda x, v: x is not None and x in v,
    GreaterThan: lambda x, v: x is not None and x > v,
    GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
    LessThan: lambda x, v: x is not None and x < v,
    LessThanOrEqual: lambda x, v: x is not None and x <= v,
    StringStartsWith: lambda x, v: x is not None and x.startswith(v),
    IsNotNull: lambda x, v: x is not None,
}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payloads = str(options.get("payload", "true")).lower() != "false"
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            if type(f) in _TESTS and name in _ARROW.names and name != "payload":
                self.tests.append((type(f), name, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        system, root = file_system(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith((".warc.gz", ".warc")) and "/_" not in x.path[len(root) :])
        ranges = []
        for path, n in files:
            if path.endswith(".warc") or n <= 2 * PARTITION_BYTES:
                ranges.append((path, 0, None, n))
            else:
                ranges += [(path, k, min(n, k + PARTITION_BYTES), PARTITION_BYTES) for k in range(0, n, PARTITION_BYTES)]
        out, held, size = [], [], 0
        for path, first, last, n in ranges:
            if held and size + n > PARTITION_BYTES:
                out.append(Files(held))
                held, size = [], 0
            held.append((path, first, last))
            size += n
        if held:
            out.append(Files(held))
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        tests = [(_TESTS[k], name, value) for k, name, value in self.tests]
        wanted = lambda row: all(t(row[name], value) for t, name, value in tests)
        rows: list[dict] = []
        size = 0
        for path, first, last in partition.ranges:
            with system.open_input_file(path) as file:
                for row in read_file(file, wanted, self.payloads, first, last):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= ROWS or size >= 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


@dataclass
class Written(WriterCommitMessage):
    paths: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.date = options.get("date") or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        self.job = uuid.uuid4().hex

    def _pending(self) -> tuple[fs.FileSystem, str]:
        system, root = file_system(self.path)
        return system, f"{root}/_pending-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, pending = self._pending()
        system.create_dir(pending, recursive=True)
        paths: list[str] = []
        file, size = None, 0
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "record_type", "refers_to")]
            for row in zip(*columns, strict=True):
                if file is None or size >= FILE_BYTES:
                    if file is not None:
                        file.close()
                    paths.append(f"{uuid.uuid4().hex}.warc.gz")
                    file, size = system.open_output_stream(f"{pending}/{paths[-1]}", compression=None), 0
                page_id, url, payload, kind, refers_to = (x.as_py() for x in row)
                size += file.write(member(record(page_id, url, payload or b"", kind, refers_to, self.date))) or 0
        if file is not None:
            file.close()
        return Written(paths)

    def commit(self, messages: list) -> None:
        system, pending = self._pending()
        root = pending.rsplit("/", 1)[0]
        system.create_dir(root, recursive=True)
        k = 0
        for m in messages:
            for name in m.paths if m is not None else []:
                system.move(f"{pending}/{name}", f"{root}/part-{k:05d}-{name}")
                k += 1
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, pending = self._pending()
        if system.get_file_info(pending).type == fs.FileType.Directory:
            system.delete_dir(pending)


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; options path, payload, date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let Spark hand it predicates (off in Spark by default)."""
    spark.dataSource.register(WarcSource)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, record_type, refers_to of each row of ``pages`` (page_id, url, html).

    A null html is empty.  Of records with equal payloads of at least ``least`` bytes, those with the
    largest page_id are responses (rows repeated with that id all are), the others revisit it; smaller
    ones are all responses.  Null ids are below all others.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("sha", F.sha1("payload"))
    holders = written(base.groupBy("sha").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").select("sha", "holder"), "holders")
    joined = base.join(holders.hint("merge"), "sha", "left")
    again = (F.length("payload") >= least) & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return joined.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("holder")).alias("refers_to"))


def archive(pages: DataFrame, path: str, least: int = 0) -> None:
    register(pages.sparkSession)
    records(pages, least).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The bare base-32 SHA-1 of bytes: five hex digits are four letters."""
    digest = F.sha1(payload)
    letters = []
    for k in range(8):
        bits = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the archives to the shared folder and read the records back.

    Responses are read with their payloads, whose lengths and digests are taken anew and must agree with
    the headers; of revisits, which hold none, only the headers are read, by a pushed predicate.
    """
    spark = pages.sparkSession
    path = scratch_dir(spark, "warc")
    archive(pages, path, least)
    whole = read(spark, path).where("record_type = 'response'")
    whole = whole.withColumns({"found_bytes": F.length("payload").cast("long"), "found_digest": base32_sha1(F.col("payload"))})
    same = F.col("payload_bytes").eqNullSafe(F.col("found_bytes")) & F.col("payload_digest").eqNullSafe(F.col("found_digest"))
    checked = F.when(same, F.col("found_digest")).otherwise(F.raise_error(F.concat(F.lit("the payload of "), F.col("record_id"), F.lit(" isn't what its headers say"))))
    responses = whole.select("page_id", F.col("found_bytes").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")
    revisits = read(spark, path, payload=False).where("record_type = 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return responses.unionByName(revisits)


def _oracle() -> str:
    """The rows of ``round_trip`` of the table ``pages``, without archives."""
    letters = " || ".join(f"substr('{ALPHABET}', 1 + ((('0x' || substr(sha, {5 * k + 1}, 5))::INTEGER >> {s}) & 31), 1)" for k in range(8) for s in (15, 10, 5, 0))
    return f"""
SELECT page_id, octet_length(encode(html)) AS payload_bytes, {letters} AS payload_digest,
       CASE WHEN holder IS NULL OR page_id IS NOT DISTINCT FROM holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM holder THEN holder END AS refers_to
FROM (SELECT page_id, html, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS holder FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))
"""


ORACLE = _oracle()
