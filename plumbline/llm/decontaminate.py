"""Benchmark decontamination with a broadcast hash set of normalised word windows.

The windows of the benchmark are hashed on the driver in slices of at most ``MOST`` windows, so that
a broadcast has a fixed bound; a larger benchmark takes one scan per slice.  A scan hashes all
windows of a text at once, looks the low bits up in a table, and verifies what remains word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from plumbline.llm.common import over_text, own_columns, text_bytes
from plumbline.llm.textvec import LOWER, Words, doc_chunks, windows

WINDOW = 10
#: Windows in one broadcast (about 150 bytes each).
MOST = 1_000_000
_BITS = 22

#: Lower-cased word bytes stay; every other ASCII byte separates.
FOLD = LOWER.copy()
FOLD[[b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)]] = 0x20
_TABLE = bytes(FOLD)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Windows:
    """Windows of some items: by length, the hash table and what each hash stands for."""

    def __init__(self) -> None:
        self.known: dict[int, dict[int, dict[bytes, set[str]]]] = {}
        self.filters: dict[int, np.ndarray] = {}
        self.count = 0

    def add(self, item: str, text: bytes) -> None:
        words = words_of(text)
        if not words:
            return
        size = min(WINDOW, len(words))
        data = np.frombuffer(b" ".join(words), dtype=np.uint8)
        found = Words(data, np.array([0, len(data)]), FOLD)
        hashes, _ = windows(found.hashes(), found.first, size, 31)
        known = self.known.setdefault(size, {})
        table = self.filters.setdefault(size, np.zeros(1 << _BITS, dtype=bool))
        table[(hashes & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        for k, h in enumerate(hashes.tolist()):
            known.setdefault(h, {}).setdefault(b" ".join(words[k : k + size]), set()).add(item)
        self.count += len(hashes)


#: Windows of an item that travel together; each piece goes on for the rest of its last window.
PIECE = 50_000


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items as runs of folded words of a bounded number of windows."""
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = words_of(text.as_py())
            more = max(0, min(WINDOW, len(words)) - 1)
            for a in range(0, max(len(words) - more, min(1, len(words))), PIECE):
                part = b" ".join(words[a : a + PIECE + more])
                yield pa.RecordBatch.from_arrays([pa.array([item]), pa.array([part], pa.binary())], ["item", "text"])


def _slices(benchmark: DataFrame) -> Iterator[Windows]:
    """The benchmark's windows in slices: executors fold and cut the items, the driver holds one slice."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_bytes().alias("text"))
    held = Windows()
    for r in rows.mapInArrow(_pieces, "item string, text binary").toLocalIterator():
        held.add(r.item, bytes(r.text))
        if held.count >= MOST:
            yield held
            held = Windows()
    yield held


def find(sought: Windows, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list, set]]]:
    """Words of each text of a chunk, and of texts with hits the word ranges and the items."""
    words = Words(data, offsets, FOLD)
    hashes = words.hashes()
    found: dict[int, tuple[list, set]] = {}
    for size, table in sought.filters.items():
        begins, maybe = _windows_of(hashes, words.first, size, table)
        known = sought.known[size]
        for k, h in zip(begins.tolist(), maybe.tolist(), strict=True):
            named = known.get(h)
            if named is None:
                continue
            own = b" ".join(words.text[s:e].tobytes() for s, e in zip(words.starts[k : k + size].tolist(), words.ends[k : k + size].tolist(), strict=True))
            if own in named:
                d = int(np.searchsorted(words.first, k, side="right")) - 1
                at = found.setdefault(d, ([], set()))
                at[0].append((k - int(words.first[d]), k - int(words.first[d]) + size))
                at[1].update(named[own])
    return words.counts, found


def _marked(windows_of):
    """Adds one slice's hits: the last columns are the text's bytes, n_words, items and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = windows_of()
        for batch in batches:
            names = batch.schema.names
            for i, j, data, offsets in doc_chunks(batch.column(batch.num_columns - 4)):
                part = batch.slice(i, j - i)
                counts, found = find(sought, data, offsets)
                items, spans = part.column(part.num_columns - 2), part.column(part.num_columns - 1)
                if found:
                    all_items, all_spans = items.to_pylist(), spans.to_pylist()
                    for d, (ranges, named) in found.items():
                        all_items[d] = sorted({*all_items[d], *named})
                        before = [(x["first"], x["last"]) for x in all_spans[d]]
                        all_spans[d] = [{"first": a, "last": b} for a, b in merged([*before, *ranges])]
                    items, spans = pa.array(all_items, pa.list_(pa.string())), pa.array(all_spans, _SPANS)
                yield pa.RecordBatch.from_arrays([*part.columns[:-3], pa.array(counts, pa.int64()), items, spans], names)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text's bytes without the words of the spans, from the first word's first byte to the last word's
    last; what stood before and behind stays as it is."""
    for batch in batches:
        texts = []
        spans = batch.column(batch.num_columns - 1)
        for i, j, data, offsets in doc_chunks(batch.column(batch.num_columns - 4)):
            words, raw = Words(data, offsets, FOLD), data.tobytes()
            for d in range(j - i):
                a, b, k = int(offsets[d]), int(offsets[d + 1]), int(words.first[d])
                parts = []
                for span in spans[i + d].as_py():
                    parts.append(raw[a : int(words.starts[k + span["first"]])])
                    a = int(words.ends[k + span["last"] - 1])
                texts.append(b"".join([*parts, raw[a:b]]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-4], pa.array(texts, pa.binary())], batch.schema.names[:-3])


def _without(windows_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = windows_of()
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            for i, _, data, offsets in doc_chunks(batch.column(batch.num_columns - 1)):
                for d in find(sought, data, offsets)[1]:
                    clean[i + d] = False
            kept = batch.filter(pa.array(clean))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], schema=pa.schema(list(kept.schema)[:-1]))

    return run


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _windows_of(hashes: np.ndarray, first: np.ndarray, size: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows that the table doesn't exclude."""
    # every text is long enough for its own windows once shorter ones are taken out
    counts = np.diff(first)
    long = counts >= size
    found, begin = windows(hashes, first, size, 31)
    maybe = np.flatnonzero(table[(found & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
    doc = np.searchsorted(begin, maybe, side="right") - 1
    keep = long[doc]
    maybe, doc = maybe[keep], doc[keep]
    return maybe - begin[doc] + first[doc], found[maybe]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _hits(rows: DataFrame, benchmark: DataFrame | None) -> DataFrame:
    """``rows``, whose last column is a text's bytes, with n_words, items and spans.

    One scan after the other adds the hits of its slice, all told in the text as it is; no shuffle.
    """
    spark = rows.sparkSession
    out = rows.select(*own_columns(rows), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<first:long,last:long>>").alias("spans"))
    schema = StructType([StructField(f.name, f.dataType) for f in out.schema])
    for held in _slices(benchmark) if benchmark is not None else [Windows()]:
        shared = spark.sparkContext.broadcast(held)
        out = out.mapInArrow(_marked(lambda b=shared: b.value), schema)
    return out


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, items, spans for each row of ``docs`` (doc_id, text).

    ``spans`` are the merged ranges of hit words (first, last + 1).  Null texts and texts without
    words have no hits; so has everything if the benchmark is empty.  An item without id is named by
    the empty string; items of one id count once.  Repeated rows are scanned each.  Other columns are
    ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return _hits(rows, benchmark).select("doc_id", "n_words", "items", "spans")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``scan``: how many words and items are hit in each document."""
    hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"]), F.lit(0).cast("long"))
    return (
        scan(docs, benchmark)
        .select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` none of whose words is hit, with all their columns of any names; no shuffle."""
    spark = docs.sparkSession
    out = docs
    for held in _slices(benchmark):
        shared = spark.sparkContext.broadcast(held)
        out = over_text(out, _without(lambda b=shared: b.value))
    return out


def without_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All rows of ``docs`` with their columns of any names; hit words are cut out of the text, null texts stay
    null.

    All words are told to be hit in the text as it was, then they are cut at once: the result is the same
    however many slices the benchmark has.  No shuffle.
    """
    slots = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*slots)
    at = slots[docs.columns.index("text")]
    found = _hits(plain.select(*slots, text_bytes(at).alias("bytes")), benchmark)
    cut = found.mapInArrow(_cut, StructType([StructField(f.name, f.dataType) for f in found.schema.fields[:-3]]))
    text = F.when(F.col(at).isNotNull(), F.col("bytes").cast(docs.schema["text"].dataType))
    return cut.select(*((text if s == at else F.col(s)).alias(c) for s, c in zip(slots, docs.columns, strict=True)))


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


#: The rows of ``report`` of the tables documents and benchmark, by joining all windows.
ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item, w, least(10, len(w)) AS size FROM (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), sought AS (
  SELECT DISTINCT item, size, array_to_string(w[k : k + size - 1], ' ') AS win FROM items, UNNEST(range(1, len(w) - size + 2)) AS u(k)
), places AS (
  SELECT r, size, k, array_to_string(w[k : k + size - 1], ' ') AS win FROM docs, (SELECT DISTINCT size FROM sought), UNNEST(range(1, greatest(len(w) - size + 2, 1))) AS u(k)
), hits AS (SELECT r, k, size, item FROM places JOIN sought USING (size, win)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS names FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN named USING (r)
"""
