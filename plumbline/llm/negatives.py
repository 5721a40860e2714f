"""Hard negatives by exact inner products, with an orthogonal rotation to discard pairs early.

Vectors are integers (``floor(256 x)``).  A rotation into principal axes, fitted on at most ``SAMPLE`` rows,
puts most of the products into the leading components.  Anchors are taken in slices of bounded size, which are
broadcast; every task holds a block of its rows against a slice, adds up the products of leading components
stage by stage, and drops the pairs whose partial product plus the norms of both remainders (and a slack for
rounding) stays below what the anchor still needs.  Survivors are verified by integer products.

A slice takes two passes over the rows: the first finds each anchor's positives, the second the negatives in
the window below each positive.  A task sends only its own best rows of each (anchor, positive) to the shuffle,
so neither a hot label nor thousands of equal vectors meet in one place.  The rotation never changes a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import scratch_dir

SAMPLE = 4096
#: Anchors of a slice and bytes of their vectors, at most about.
SLICE, SLICE_BYTES = 4096, 32 << 20
#: Rows and anchors that meet in one product.
ROWS, ANCHORS = 2048, 1024
#: Parts of the energy that may lie behind the leading components of a stage.
BEHIND = (0.5, 0.25, 0.1)
#: Scores are exact up to here, and held here beyond, so that a hundred times a score is a 64-bit number.
MOST = 9 * 10**16
_EXACT = float(1 << 53)


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of each component, as doubles; shorter vectors go on with zeros."""
    out = np.zeros((len(column), width))
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(lengths) - lengths
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(begin, lengths)] = np.floor(256.0 * flat)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and b, row by row."""
    big = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1) >= _EXACT / 4
    out = np.einsum("ij,ij->i", np.where(big[:, None], 0.0, a), b) if big.any() else np.einsum("ij,ij->i", a, b)
    score = out.astype(np.int64)
    for k in np.flatnonzero(big):
        exact = sum(int(x) * int(y) for x, y in zip(a[k], b[k], strict=True))
        score[k] = max(-MOST, min(MOST, exact))
    return score


class Rotation:
    """Principal axes of a sample, and after how many components the stages end."""

    def __init__(self, sample: np.ndarray):
        width = sample.shape[1]
        scale = max(1.0, float(np.abs(sample).max(initial=0.0)))
        energy, axes = np.linalg.eigh((sample / scale).T @ (sample / scale))
        self.axes = np.ascontiguousarray(axes[:, ::-1])
        left = 1.0 - np.cumsum(np.maximum(energy[::-1], 0.0)) / max(float(np.maximum(energy, 0.0).sum()), 1e-300)
        ends = sorted({int(np.argmax(left <= part)) + 1 for part in BEHIND})
        self.ends = [m for m in ends if m < width]
        #: relative error of a rotated product, by far
        self.slack = 8.0 * (width + 8) * float(np.finfo(np.float64).eps)

    def turned(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated vectors, and for each stage the norm of what is behind it, then the whole norm."""
        out = vectors @ self.axes
        square = out * out
        norms = [np.sqrt(square[:, m:].sum(axis=1)) * (1.0 + 1e-9) for m in (*self.ends, 0)]
        return out, np.stack(norms, axis=1)


class Slice:
    """Anchors: ids, labels, integer vectors, rotated ones, and what their rows must reach."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, rotation: Rotation):
        self.ids, self.labels, self.vectors, self.rotation = ids, labels, vectors, rotation
        self.turned, self.norms = rotation.turned(vectors)


def survivors(held: Slice, vectors: np.ndarray, allowed: Callable[[slice], np.ndarray], need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, anchor, score) of the allowed pairs whose score reaches ``need`` of the anchor."""
    rotation = held.rotation
    turned, norms = rotation.turned(vectors)
    for first in range(0, len(held.ids), ANCHORS):
        of = slice(first, min(first + ANCHORS, len(held.ids)))
        alive = allowed(of)
        partial = np.zeros(alive.shape)
        done = 0
        for k, m in enumerate(rotation.ends):
            if np.count_nonzero(alive) * 50 < alive.size:
                break
            partial += turned[:, done:m] @ held.turned[of, done:m].T
            done = m
            rest = np.stack([norms[:, k], rotation.slack * norms[:, -1]], axis=1) @ np.stack([held.norms[of, k], held.norms[of, -1]])
            alive &= partial + rest >= need[of]
        row, anchor = np.nonzero(alive)
        for a in range(0, len(row), 1 << 16):
            i, j = row[a : a + (1 << 16)], anchor[a : a + (1 << 16)] + first
            score = products(vectors[i], held.vectors[j])
            good = score >= need[j]
            yield i[good], j[good], score[good]


def best(key: np.ndarray, score: np.ndarray, ident: np.ndarray, most: int) -> np.ndarray:
    """Where the first ``most`` of each key are, by score from above, then id."""
    order = np.lexsort((ident, -score, key))
    head = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(order) else np.zeros(0, bool)
    begin = np.flatnonzero(head)
    rank = np.arange(len(order)) - begin[np.cumsum(head) - 1] if len(order) else np.zeros(0, int)
    return order[rank < most]


class Best:
    """The first ``most`` rows of each key, and what a row must reach to be among them."""

    def __init__(self, keys: int, most: int, need: np.ndarray):
        self.most, self.need, self.keys = most, need.astype(np.float64), keys
        self.key, self.score, self.ident = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, key: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(key):
            return
        both = [np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.ident, ident))]
        kept = best(*both, self.most)
        self.key, self.score, self.ident = (x[kept] for x in both)
        last = np.flatnonzero(np.bincount(self.key, minlength=self.keys)[self.key] >= self.most)
        low = np.full(self.keys, np.iinfo(np.int64).max)
        np.minimum.at(low, self.key[last], self.score[last])
        full = np.unique(self.key[last])
        self.need[full] = np.maximum(self.need[full], low[full].astype(np.float64))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), integers(part.column(2), width)


def _positives(shared, most: int, seeds) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Slice = shared.value
        found = Best(len(held.ids), most, seeds.value)
        for ids, labels, vectors in _blocks(batches, held.vectors.shape[1]):
            for label in np.unique(labels):
                own, of = np.flatnonzero(labels == label), np.flatnonzero(held.labels == label)
                if not len(of):
                    continue
                part = Slice.__new__(Slice)
                part.ids, part.labels, part.vectors, part.rotation = held.ids[of], held.labels[of], held.vectors[of], held.rotation
                part.turned, part.norms = held.turned[of], held.norms[of]
                for i, j, score in survivors(part, vectors[own], lambda s, o=own, p=part: ids[o][:, None] != p.ids[s], found.need[of]):
                    found.add(of[j], score, ids[own][i])
        yield pa.RecordBatch.from_arrays([pa.array(held.ids[found.key]), pa.array(found.ident), pa.array(found.score)], ["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(shared, most: int, low: int, high: int, positives) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Slice = shared.value
        of, score = positives.value  # anchor and score of each positive, by anchor
        floor = np.where(low * score <= high * score, -((-low * score) // 100), np.iinfo(np.int64).max).astype(np.float64)
        ceiling = (high * score) // 100
        begin = np.searchsorted(of, np.arange(len(held.ids) + 1))
        found = Best(len(of), most, floor)
        for ids, labels, vectors in _blocks(batches, held.vectors.shape[1]):
            need = np.full(len(held.ids), np.inf)
            np.minimum.at(need, of, found.need)
            for i, j, own in survivors(held, vectors, lambda s: labels[:, None] != held.labels[s], need):
                count = begin[j + 1] - begin[j]
                at = np.repeat(np.arange(len(j)), count)
                key = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + begin[j][at]
                fits = (own[at] >= found.need[key]) & (own[at] <= ceiling[key])
                found.add(key[fits], own[at][fits], ids[i][at[fits]])
        yield pa.RecordBatch.from_arrays([pa.array(found.key), pa.array(found.ident), pa.array(found.score)], ["place", "negative_id", "negative_score"])

    return run


def usable(embeddings: DataFrame, label: Column, anchor: Column) -> DataFrame:
    """vec_id, label, embedding, anchor of the rows that take part; of rows with one id the least stands.

    Rows without an id, a label or a vector, and those with a null or non-finite component take no part.
    Only ids that repeat are shuffled with their vectors.
    """
    whole = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = embeddings.where("vec_id is not null and label is not null and embedding is not null").where(whole)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding", anchor.alias("anchor"))
    twice = rows.groupBy("vec_id").count().where("count > 1").select("vec_id")
    if twice.isEmpty():
        return rows
    least = F.min(F.struct("label", "embedding", "anchor")).alias("row")
    some = rows.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(least).select("vec_id", "row.*")
    return rows.join(twice, "vec_id", "left_anti").unionByName(some)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Hard negatives for each anchor and positive of ``rows`` (as ``usable`` gives them).

    An anchor's positives are its first ``positives`` other rows of the same label, by integer inner product
    and then the smaller id; negatives are the first of other labels with a score of ``low`` to ``high`` percent
    of the positive's.  Fewer rows give fewer positives or negatives; no anchors give an empty table.  Vectors
    shorter than the longest go on with zeros.
    """
    spark = rows.sparkSession
    seen = rows.agg(F.max(F.size("embedding")).alias("width"), F.count_if("anchor").alias("anchors")).first()
    if not seen.anchors:
        return spark.createDataFrame([], RESULT)
    width = max(1, seen.width)
    columns = ["vec_id", "label", "embedding"]
    fits = max(64, SLICE_BYTES // (16 * width))
    some = rows.select(*columns).orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE, fits)).toArrow().combine_chunks().to_batches()
    sample = next(_sampled(some, width))
    rotation = Rotation(sample[2])
    count = -(-seen.anchors // min(SLICE, fits))
    paths = []
    for k in range(count):
        mine_ = rows.where(F.col("anchor") & (F.pmod(F.xxhash64("vec_id"), F.lit(count)) == k)).select(*columns)
        part = next(_sampled(mine_.toArrow().combine_chunks().to_batches(), width), None)
        if part is None:
            continue
        order = np.argsort(part[0])
        paths.append(_slice(rows.select(*columns), Slice(part[0][order], part[1][order], part[2][order], rotation), sample, positives, negatives, low, high))
    return spark.read.schema(RESULT).parquet(*paths)


def _sampled(batches: list[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        yield b.column(0).to_numpy(), b.column(1).to_numpy(), integers(b.column(2), width)


def _seeds(held: Slice, sample: tuple, most: int) -> np.ndarray:
    """What the sample alone already gives each anchor for its last positive: less is never needed."""
    ids, labels, vectors = sample
    found = Best(len(held.ids), most, np.full(len(held.ids), -np.inf))
    for i, j, score in survivors(held, vectors, lambda s: (labels[:, None] == held.labels[s]) & (ids[:, None] != held.ids[s]), found.need):
        found.add(j, score, ids[i])
    return found.need


def _slice(rows: DataFrame, held: Slice, sample: tuple, positives: int, negatives: int, low: int, high: int) -> str:
    """Both passes for one slice of anchors; where its rows of the result are."""
    spark = rows.sparkSession
    context = spark.sparkContext
    shared, seeds = context.broadcast(held), context.broadcast(_seeds(held, sample, positives))
    found = rows.mapInArrow(_positives(shared, positives, seeds), "anchor_id long, positive_id long, positive_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    first = found.withColumn("r", rank).where(F.col("r") <= positives).drop("r").orderBy("anchor_id", "positive_id").toPandas()
    of = np.searchsorted(held.ids, first["anchor_id"].to_numpy(dtype=np.int64))
    score = first["positive_score"].to_numpy(dtype=np.int64)
    places = context.broadcast((of, score))
    low_rows = rows.mapInArrow(_negatives(shared, negatives, low, high, places), "place long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("negative_score"), "negative_id"))
    first["place"] = np.arange(len(first))
    names = spark.createDataFrame(first, "anchor_id long, positive_id long, positive_score long, place long")
    path = scratch_dir(spark, "negatives")
    ranked = low_rows.withColumn("rank", rank).where(F.col("rank") <= negatives)
    ranked.join(F.broadcast(names), "place").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.parquet(path)
    for b in (shared, seeds, places):
        b.unpersist()
    return path


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """``mine`` over ``embeddings`` (vec_id, label, embedding): ids divisible by 7 count with the next of ten
    labels, ids divisible by 100 are anchors.  Other columns are ignored."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(usable(embeddings, moved, F.col("vec_id") % 100 == 0))


#: The rows of ``hard_negatives`` of the table embeddings, by all products of anchors.
ORACLE = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
