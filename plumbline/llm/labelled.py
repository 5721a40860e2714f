"""Bounded samples of labelled texts, and scans that keep a table's own columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fold_of, over_text, text_bytes, written


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, modulus: int | None = None, held: int | None = None) -> DataFrame:
    """(text bytes, label) of at most ``most`` labelled rows of each class.

    Rows are taken in the order of a hash of the id, so the sample is the same at every run; a document
    labelled twice counts with its least label, one without label or id not at all.  Rows of the fold
    ``held`` are left out.  Rows of equal id and text count once, so repeats don't grow what is learned from.
    The sample is the only broadcast: its bound is ``2 * most`` rows of ids.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if modulus is not None:
        known = known.where(fold_of(modulus) != held)
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min(F.col(label).cast("int")).alias("__label"))
    parts = [known.where(c).orderBy(F.xxhash64("__id"), "__id").limit(most) for c in ("__label = 0", "__label <> 0")]
    chosen = parts[0].union(parts[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), text_bytes().alias("text"))
    return texts.join(F.broadcast(chosen), "__id").select("__id", "text", F.col("__label").alias("label")).distinct()


def fitting(sizes: dict[int, int], most_bytes: int) -> int:
    """The largest length that texts can be read up to so that all of them fit; ``sizes`` has how many
    texts there are of each length."""
    left, n = most_bytes, sum(sizes.values())
    for size in sorted(sizes):
        if size * n > left:
            return left // n
        left -= size * sizes[size]
        n -= sizes[size]
    return max(sizes, default=0)


def whole_ones(rows: list[tuple], most_bytes: int) -> set:
    """Which of the rows (key, label, size) are taken, so that all texts are whole and fit ``most_bytes``.

    Each of two classes has half of the bytes, and what the other one leaves; the shortest texts come first.
    """
    classes = [sorted((size, key) for key, label, size in rows if (label == 0) is none) for none in (True, False)]
    totals = [sum(size for size, _ in c) for c in classes]
    half = most_bytes // 2
    bounds = [max(half, most_bytes - totals[1]), max(half, most_bytes - totals[0])]
    taken = set()
    for c, left in zip(classes, bounds, strict=True):
        for size, key in c:
            if size > left:
                break
            left -= size
            taken.add(key)
    return taken


def to_driver(sample: DataFrame, most_bytes: int) -> tuple[list[bytes], np.ndarray]:
    """The sample's texts and labels, in the order of their ids' hash: whole texts, in so many bytes.

    Where they don't all fit, the longest texts of a class are not learned from; no text is cut, and none costs
    a shorter one its place.
    """
    key = F.xxhash64("__id", "text")
    sample = written(sample.withColumn("key", key), "labelled", "zstd")
    sizes = [(r.key, r.label, r["size"]) for r in sample.select("key", "label", F.length("text").alias("size")).distinct().collect()]
    chosen = whole_ones(sizes, most_bytes)
    if len(chosen) < len(sizes):
        few = sample.sparkSession.createDataFrame([(k,) for k in sorted(chosen)], "key long")
        sample = sample.join(F.broadcast(few), "key", "left_semi")
    texts, labels = [], []
    for row in sample.orderBy(F.xxhash64("__id"), "__id", "text").toLocalIterator():
        texts.append(bytes(row.text))
        labels.append(row.label)
    return texts, np.array(labels, dtype=np.int64)


def kept_by(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """Rows of ``docs`` whose text bytes ``keep`` accepts, with all their columns; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(keep(batch.column(batch.num_columns - 1))))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], schema=pa.schema(list(kept.schema)[:-1]))

    return over_text(docs, run)
