"""Lines that many documents repeat, by levelled sorted runs of line hashes.

A run holds one row per line key: its 128-bit hash, in how many documents of its batches it stands (at
least), and the largest id of them.  Runs are tables bucketed and sorted by the hash, so a batch is
merge-joined with them, and they with each other, without another shuffle:

1. a batch counts its own keys and drops those that a run has settled, that is, counted often enough with
   a last document that isn't smaller (a merge anti-join with each run); the rest becomes a run of level 0;
2. as soon as a level holds ``FANOUT`` runs, they are merged into one run of the next level;
3. at the end the runs are merged once more; keys of enough documents go from all but the last of them.

A batch is a set of whole documents.  Settled keys add nothing, so a line that stands everywhere costs at
most one row a batch, and counts in runs are lower bounds that are exact below the limit.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import scratch_dir, text_bytes, written
from plumbline.llm.hot import join_shared

#: Code points of a key that is looked at, and documents from which its lines go.
LEAST, DOCUMENTS = 20, 3
BATCHES, FANOUT = 4, 2
_BLANK = b" \t\n\x0b\x0c\r"


def key_of(line: bytes) -> bytes | None:
    """Hash of a line's key, or None if the key is too short to count."""
    key = line.strip(_BLANK).lower()  # of bytes: A-Z only
    if len(key) < LEAST or len(key) < 4 * LEAST and len(key.decode("utf-8", "replace")) < LEAST:
        return None
    return hashlib.md5(key, usedforsecurity=False).digest()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = ({key_of(x) for x in text.as_py().split(b"\n")} - {None} for text in batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(sorted, found), pa.list_(pa.binary()))], ["doc_id", "tag", "keys"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, dropped, texts = [], [], []
        for text, gone in zip(batch.column(1), batch.column(2), strict=True):
            own = text.as_py().split(b"\n")
            bad = set(gone.as_py() or ())
            left = [x for x in own if key_of(x) not in bad] if bad else own
            lines.append(len(own))
            dropped.append(len(own) - len(left))
            texts.append(b"\n".join(left))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary())], ["own", "n_lines", "n_dropped", "kept"])


class Runs:
    """Levelled sorted runs of (key binary, n long, last: type of the document ids)."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: list[str] = []

    def _stored(self, df: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "key").sortBy("key").option("path", scratch_dir(self.spark, name)).format("parquet").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs as one: counts added, the larger last document; a null id is the smallest."""
        b = b.select(F.col("key").alias("other"), F.col("n").alias("m"), F.col("last").alias("late"))
        both = a.join(b.hint("merge"), F.col("key") == F.col("other"), "full_outer")
        count = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
        return both.select(F.coalesce("key", "other").alias("key"), count.alias("n"), F.greatest("last", "late").alias("last"))

    def add(self, pairs: DataFrame) -> None:
        """A batch: (doc_id, key) of whole documents that no other batch holds; repeats count once."""
        fresh = pairs.groupBy("key").agg(F.countDistinct(F.struct("doc_id")).alias("n"), F.max("doc_id").alias("last"))
        for run in (r for level in self.levels for r in level):
            settled = run.where(F.col("n") >= DOCUMENTS).select(F.col("key").alias("other"), F.col("last").alias("late"))
            past = F.col("last").isNull() | (F.col("late") >= F.col("last"))
            fresh = fresh.join(settled.hint("merge"), (F.col("key") == F.col("other")) & past, "left_anti")
        self._put(0, self._stored(fresh))

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        held = [*self.levels[level], run]
        if len(held) < self.fanout:
            self.levels[level] = held
            return
        self.levels[level] = []
        whole = held[0]
        for other in held[1:]:
            whole = self._merged(whole, other)
        self._put(level + 1, self._stored(whole))

    def repeated(self) -> DataFrame:
        """(key, n, last) of the keys that enough documents hold; nothing before the first batch."""
        runs = [r for level in self.levels for r in level]
        if not runs:
            return self.spark.createDataFrame([], "key binary, n long, last long")
        whole = runs[0]
        for other in runs[1:]:
            whole = self._merged(whole, other)
        return whole.where(F.col("n") >= DOCUMENTS)

    def forget(self) -> None:
        """Take the tables out of the catalogue; their files stay in the scratch folder."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = []


def _dropped_keys(docs: DataFrame, batches: int) -> DataFrame:
    """(doc_id, tag, keys): what each row of a document loses; rows that lose nothing are missing."""
    spark = docs.sparkSession
    found = docs.select("doc_id", "tag", "bytes").mapInArrow(_keys, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tag long, keys array<binary>")
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    path = scratch_dir(spark, "line-keys")
    found.select("doc_id", "tag", F.explode("keys").alias("key"), batch.alias("batch")).write.partitionBy("batch").parquet(path)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tag long, key binary, batch int"
    pairs = spark.read.schema(schema).parquet(path)
    total = pairs.count()
    runs = Runs(spark)
    for k in range(batches):
        runs.add(pairs.where(F.col("batch") == k))
    repeated = written(runs.repeated(), "repeated-lines")
    runs.forget()
    hits = join_shared(pairs.drop("batch"), repeated, ["key"], "n", total)
    return hits.where(~F.col("doc_id").eqNullSafe(F.col("last"))).groupBy("doc_id", "tag").agg(F.collect_set("key").alias("keys"))


def _reduced(docs: DataFrame, own, batches: int) -> DataFrame:
    """own, n_lines, n_dropped, kept (bytes) for each row."""
    rows = docs.select(own.alias("own"), F.col("doc_id"), F.xxhash64("text").alias("tag"), text_bytes().alias("bytes"))
    gone = _dropped_keys(rows, batches).select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "keys")
    both = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left")
    kind = rows.schema["own"].dataType.simpleString()
    return both.select("own", "bytes", "keys").mapInArrow(_kept, f"own {kind}, n_lines long, n_dropped long, kept binary")


def report(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of ``docs`` (doc_id, text).

    A null or empty text is one empty line.  Rows of one id are one document, and keep the same lines; rows
    without an id are one document before all others.  An empty table gives an empty one; other columns are
    ignored; very long texts are read whole, line by line.
    """
    kept = _reduced(docs.select("doc_id", "text"), F.col("doc_id"), batches)
    return kept.select(F.col("own").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """All rows and columns of ``docs``, texts without the lines that ``report`` drops; null texts stay null.

    Columns of any name are carried along untouched (as one struct)."""
    names = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    slots = [f"c{k}" for k in range(len(names))]
    own = F.struct(*(F.col(n).alias(s) for n, s in zip(names, slots, strict=True)))
    kept = _reduced(docs, own, batches)
    text = slots[docs.columns.index("text")]
    new = F.when(F.col(f"own.{text}").isNotNull(), F.col("kept").cast("string"))
    return kept.select(*((new if s == text else F.col(f"own.{s}")).alias(c) for s, c in zip(slots, docs.columns, strict=True)))


#: The rows of ``report`` of the table documents.
ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT r, doc_id, k, lines[k] AS line, translate(trim(lines[k], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM docs, UNNEST(range(1, len(lines) + 1)) AS u(k)
), repeated AS (SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT r, k, line, last IS NOT NULL AND last <> doc_id AS gone FROM lines LEFT JOIN repeated USING (key)),
kept AS (SELECT r, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS body FROM marked GROUP BY r)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, n_dropped, sha256(body) AS kept_sha256 FROM docs JOIN kept USING (r)
"""
