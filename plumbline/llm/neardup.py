"""Near duplicates by min-max hashing.

Signatures keep both the minimum and the maximum of every permutation, so ``HASHES`` evaluations
give 2 x ``HASHES`` unbiased entries; ``BANDS`` bands of ``ROWS`` entries are the candidate keys.
The plan, whose steps are all linear in the distinct texts but for the last resort:

1. texts with equal shingle sets fall together (a 128-bit sum of their shingles), so copies cost
   one partial aggregate and never meet in a bucket;
2. each map task joins its own rows of a bucket by a star and sends one row per bucket on, so that
   a hot bucket brings at most one row per task to the shuffle;
3. the connected groups of the bucket graph are cut into blocks of at most ``BLOCK`` texts and about
   ``WEIGHT`` shingles, and in each block the links are confirmed on full sets; a group of several
   blocks is first merged block by block, and then what stayed outside of its largest class is
   compared with the whole group, in blocks;
4. classes are the connected components of the confirmed links, and of the versions of one doc_id.

Two texts that share a bucket are hence always compared or already known to be in one class: no
bucket is capped.  A pair at the threshold shares no bucket with a chance of (1 - 0.75^5)^40, about
2e-5, if both ends of a permutation are independent, as they nearly are in large sets; in the smallest
ones (three shingles of four shared) they aren't, and it is about 2e-4.  Both fall for larger
similarities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import give_back, text_bytes, written
from plumbline.llm.components import components
from plumbline.llm.textvec import Words, doc_chunks, mix, stream, windows

SHINGLE = 5
ROWS, BANDS = 5, 40
HASHES = ROWS * BANDS // 2
BLOCK = 256
#: Shingles of a block, about: a block's sets take some 100 MB of a worker at most.
WEIGHT = 2_000_000
SAMPLE = 8

_U = np.uint64
_MUL, _ADD = stream(HASHES, 21) | _U(1), stream(HASHES, 22)
_PRINT = stream(2, 23)
#: Documents whose buckets a map task holds at a time.
HELD = 100_000


def shingle_sets(column) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for i, j, data, offsets in doc_chunks(column):
        words = Words(data, offsets)
        found, begin = windows(words.hashes(), words.first, SHINGLE, 3)
        for k in range(j - i):
            yield i + k, np.unique(found[begin[k] : begin[k + 1]])


def signatures(found: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Band keys of the runs of ``found``; no run may be empty."""
    values = np.empty((2 * HASHES, len(begin)), dtype=_U)
    for h in range(HASHES):
        v = found * _MUL[h] + _ADD[h]
        values[2 * h] = np.minimum.reduceat(v, begin)
        values[2 * h + 1] = np.maximum.reduceat(v, begin)
    keys = np.empty((len(begin), BANDS), dtype=_U)
    for b in range(BANDS):
        key = np.full(len(begin), b + 1, dtype=_U)
        for r in range(ROWS):
            key = mix(key * _U(0x9E3779B97F4A7C15) + values[b * ROWS + r])
        keys[:, b] = key
    return keys


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(1)
        for i, j, data, offsets in doc_chunks(column):
            words = Words(data, offsets)
            found, begin = windows(words.hashes(), words.first, SHINGLE, 3)
            n = j - i
            size = np.zeros(n, dtype=np.int64)
            prints = np.zeros((2, n), dtype=_U)
            some = np.flatnonzero(np.diff(begin) > 0)
            bands = np.zeros((n, BANDS), dtype=_U)
            if len(some):
                distinct = [np.unique(found[begin[k] : begin[k + 1]]) for k in some]
                size[some] = [len(x) for x in distinct]
                flat = np.concatenate(distinct)
                at = np.concatenate([[0], np.cumsum(size[some])[:-1]])
                for k in range(2):
                    prints[k, some] = np.add.reduceat(mix(flat + _PRINT[k]), at)
                bands[some] = signatures(flat, at)
            raw = [row.tobytes() if s else b"" for row, s in zip(bands, size, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, n), pa.array(size), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), pa.array(raw, pa.binary())],
                ["doc_id", "n_shingles", "p0", "p1", "bands"],
            )
    give_back()


def _bucket_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task's rows of each bucket to the least of them (key null), and that least one with
    the bucket's key for the shuffle."""

    def flush(ids: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
        node, key = np.concatenate(ids), np.concatenate(keys).reshape(-1)
        node = np.repeat(node, BANDS)
        order = np.lexsort((node, key))
        node, key = node[order], key[order]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        least = node[np.flatnonzero(head)[np.cumsum(head) - 1]]
        inner = ~head & (node != least)
        pairs = np.unique(np.stack([node[inner], least[inner]], axis=1), axis=0) if inner.any() else np.zeros((0, 2), np.int64)
        n = len(pairs)
        at = np.flatnonzero(head)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.zeros(n, np.int64), key[at].view(np.int64)]), mask=np.arange(n + len(at)) < n),
                pa.array(np.concatenate([pairs[:, 0], node[at]])),
                pa.array(np.concatenate([pairs[:, 1], node[at]])),
            ],
            ["key", "a", "b"],
        )

    ids, keys, held = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        keys.append(np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=_U).reshape(-1, BANDS))
        held += batch.num_rows
        if held >= HELD:
            yield flush(ids, keys)
            ids, keys, held = [], [], 0
    if held:
        yield flush(ids, keys)


class Sets:
    """The sets of a block, side by side, with exact intersections of one against many."""

    def __init__(self, nodes: np.ndarray, sets: list[np.ndarray]):
        self.nodes = nodes
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        values = np.concatenate(sets) if sets else np.zeros(0, _U)
        self.names, self.flat = np.unique(values, return_inverse=True)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.mark = np.zeros(len(self.names), dtype=np.int32)

    def similar(self, k: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` are linked with set k."""
        own = self.flat[self.begin[k] : self.begin[k + 1]]
        self.mark[own] = 1
        lengths = self.sizes[others]
        at = np.concatenate([[0], np.cumsum(lengths)])
        places = np.arange(at[-1]) - np.repeat(at[:-1], lengths) + np.repeat(self.begin[others], lengths)
        both = np.add.reduceat(self.mark[self.flat[places]], at[:-1]).astype(np.int64)
        self.mark[own] = 0
        return 100 * both >= 75 * (lengths + len(own) - both)


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def block_links(sets: Sets, queries: np.ndarray, roots: np.ndarray) -> list[tuple[int, int]]:
    """Confirmed links that join different classes: each query against all of the block.

    ``roots`` holds class numbers so far; pairs of one class are not compared.
    """
    parent = np.arange(len(sets.nodes))
    first: dict[int, int] = {}
    for k, c in enumerate(roots.tolist()):
        parent[k] = first.setdefault(c, k)
    found = []
    for q in queries.tolist():
        top = np.array([_find(parent, k) for k in range(len(parent))]) if len(parent) < 3 else None
        if top is None:
            while True:  # full path compression, vectorised
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            top = parent
        others = np.flatnonzero((top != top[q]) & (sets.sizes > 0))
        # sizes alone exclude most pairs of unlike length
        others = others[(4 * sets.sizes[others] >= 3 * sets.sizes[q]) & (3 * sets.sizes[others] <= 4 * sets.sizes[q])]
        if not len(others):
            continue
        for o in others[sets.similar(q, others)].tolist():
            a, b = _find(parent, q), _find(parent, o)
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((q, o))
    return found


def _read_block(table: pa.Table) -> tuple[Sets, pa.Table]:
    nodes = table.column("node").to_numpy()
    sets: list = [None] * table.num_rows
    for row, s in shingle_sets(table.column("text")):
        sets[row] = s
    return Sets(nodes, sets), table


_LINKS = pa.schema([("grp", pa.int64()), ("block", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("sampled", pa.bool_())])


def _block_classes(table: pa.Table) -> pa.Table:
    """Within one block, the links to the least node of each class; some rows of the largest class
    are marked to stand for the block when blocks are merged."""
    sets, _ = _read_block(table)
    n = len(sets.nodes)
    order = np.argsort(sets.nodes, kind="stable")
    links = block_links(sets, order, sets.nodes)
    parent = np.arange(n)
    for a, b in links:
        x, y = _find(parent, a), _find(parent, b)
        parent[max(x, y)] = min(x, y)
    top = np.array([_find(parent, k) for k in range(n)])
    largest = np.bincount(top, minlength=n).argmax()
    member = np.flatnonzero(top == largest)
    sampled = np.zeros(n, dtype=bool)
    sampled[member[np.linspace(0, len(member) - 1, min(SAMPLE, len(member))).astype(int)]] = True
    grp, block = table.column("grp")[0].as_py(), table.column("block")[0].as_py()
    return pa.table([pa.array(np.full(n, grp)), pa.array(np.full(n, block)), pa.array(sets.nodes), pa.array(sets.nodes[top]), pa.array(sampled)], schema=_LINKS)


def _cross_links(table: pa.Table) -> pa.Table:
    """Queries of a block against its members, where their classes differ."""
    sets, _ = _read_block(table)
    asked = np.flatnonzero(table.column("asked").to_numpy(zero_copy_only=False))
    links = block_links(sets, asked, table.column("cls").to_numpy())
    n = len(links)
    a = np.array([sets.nodes[x] for x, _ in links], dtype=np.int64)
    b = np.array([sets.nodes[y] for _, y in links], dtype=np.int64)
    return pa.table([pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(a), pa.array(b), pa.array(np.zeros(n, bool))], schema=_LINKS)


_LINKS_DDL = "grp long, block long, a long, b long, sampled boolean"


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    A null text is empty; a text without words has no shingles and links with nothing.  Rows of one
    doc_id are versions of one document and share their links.  A row without doc_id belongs to its
    class, whose id is the least doc_id there is (null if there is none), and is never kept unless it
    is alone without ids.  Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    rows = written(base.mapInArrow(_features, "doc_id long, n_shingles long, p0 long, p1 long, bands binary"), "minmax")
    some = rows.where("n_shingles > 0 and doc_id is not null")
    classes = written(some.groupBy("p0", "p1", "n_shingles").agg(F.min("doc_id").alias("rep")), "sets")

    # one row of bands for each distinct set
    reps = (
        some.join(classes.select(F.col("rep").alias("doc_id"), F.col("p0").alias("q0"), F.col("p1").alias("q1")).hint("merge"), "doc_id")
        .where("p0 = q0 and p1 = q1")
        .select("doc_id", "bands")
    )
    stars = written(reps.mapInArrow(_bucket_stars, "key long, a long, b long"), "buckets")
    shared = stars.where("key is not null").select("key", "a")
    from pyspark.sql import Window

    across = shared.select("a", F.min("a").over(Window.partitionBy("key")).alias("b"))
    candidates = stars.where("key is null").select("a", "b").union(across)
    groups = components(candidates, "groups")
    groups = written(groups.select(F.col("node"), F.col("component").alias("grp")), "groups")
    weights = classes.groupBy(F.col("rep").alias("node")).agg(F.sum("n_shingles").alias("weight"))
    sizes = groups.join(weights.hint("merge"), "node").groupBy("grp").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    # blocks of a group, and how many of its rows one holds
    parts = F.greatest(F.when(F.col("n") <= BLOCK, F.lit(1)).otherwise(F.ceil(F.col("n") / (BLOCK * 0.75))), F.least("n", F.ceil(F.col("weight") / WEIGHT)))
    sizes = written(sizes.withColumn("parts", parts.cast("long")).withColumn("per", F.ceil(F.col("n") / F.col("parts")).cast("long")), "group-sizes")
    # the texts of grouped sets, once per distinct text of a node
    blocks = F.pmod(F.xxhash64("node"), F.col("parts"))
    placed = written(groups.join(sizes, "grp").select("node", "grp", "parts", blocks.cast("long").alias("block")), "placed")
    members = written(
        base.where("doc_id is not null").join(placed.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id")
        .select("grp", "block", "parts", F.col("doc_id").alias("node"), "text"),
        "members",
    )
    found = written(members.select("grp", "block", "node", "text").groupBy("grp", "block").applyInArrow(_block_classes, _LINKS_DDL), "block-links")
    links = found.select("a", "b")

    large = sizes.where("parts > 1")
    if not large.isEmpty():
        links = _merge_large(members.where("parts > 1"), found, links, large.select("grp", "per"))

    labels = components(links.union(_versions(some, classes)), "classes").select(F.col("node").alias("rep"), "component")
    known = written(classes.join(labels, "rep", "left").select("p0", "p1", "n_shingles", F.coalesce("component", "rep").alias("component")), "class-ids")
    out = rows.select("doc_id", "n_shingles", "p0", "p1").join(known.hint("merge"), ["p0", "p1", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _versions(some: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that share a doc_id; most corpora have none."""
    key = F.struct("p0", "p1", "n_shingles")
    several = written(some.groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi").select("doc_id"), "versions")
    if several.isEmpty():
        return classes.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    held = some.join(several, "doc_id").select("doc_id", "p0", "p1", "n_shingles").distinct().join(classes, ["p0", "p1", "n_shingles"]).select("doc_id", "rep")
    held = written(held, "version-classes")
    least = held.groupBy("doc_id").agg(F.min("rep").alias("b"))
    return held.join(least, "doc_id").select(F.col("rep").alias("a"), "b")


def _merge_large(members: DataFrame, found: DataFrame, links: DataFrame, per: DataFrame) -> DataFrame:
    """The exact way for groups of more than one block; ``per`` has how many rows a group's blocks hold."""
    # classes so far follow from labels alone; what they leave apart only costs comparisons
    texts = members.select("node", "text")
    ids = members.select("grp", "node").distinct()
    state = written(ids.join(found.select(F.col("a").alias("node"), F.col("b").alias("cls")), "node"), "state")
    level = found.join(ids.select("grp").distinct(), "grp", "left_semi").where("sampled").select("grp", F.col("a").alias("node"), "block")
    fan = F.greatest(F.lit(2), F.least(F.lit(48), F.floor(F.col("per") / 4)))
    while True:
        # rows that stand for their blocks meet, up to 48 blocks at a time, fewer where texts are long
        level = level.join(per, "grp").withColumn("block", F.floor(F.col("block") / fan).cast("long")).drop("per")
        meet = level.join(texts, "node").select("grp", "block", "node", "text")
        merged = written(meet.groupBy("grp", "block").applyInArrow(_block_classes, _LINKS_DDL), "merge-links")
        links = links.union(merged.select("a", "b"))
        tops = state.join(merged.select(F.col("a").alias("node"), F.col("b").alias("top")), "node").groupBy("cls").agg(F.min("top").alias("top"))
        state = written(state.join(tops, "cls", "left").select("grp", "node", F.least("cls", "top").alias("cls")), "state")
        level = merged.where("sampled").select("grp", F.col("a").alias("node"), "block")
        if merged.where("block > 0").isEmpty():
            break
    from pyspark.sql import Window

    counts = state.groupBy("grp", "cls").agg(F.count("*").alias("c"))
    main = counts.groupBy("grp").agg(F.max(F.struct("c", "cls")).alias("m"), F.sum("c").alias("all")).select("grp", F.col("m.cls").alias("main"), (F.col("all") - F.col("m.c")).alias("out"), F.col("all"))
    main = written(main.where(F.col("out") > 0), "outside")
    rows = state.join(main, "grp").join(per, "grp")
    n_ask, n_all = F.ceil(F.col("out") / F.col("per")), F.ceil(F.col("all") / F.col("per"))
    ask_block = F.pmod(F.xxhash64("node", F.lit(1)), n_ask)
    all_block = F.pmod(F.xxhash64("node", F.lit(2)), n_all)
    grid = lambda i, j: (i * n_all + j).cast("long")
    asked = rows.where("cls <> main").select("grp", "node", "cls", F.lit(True).alias("asked"), F.explode(F.transform(F.sequence(F.lit(0).cast("long"), n_all - 1), lambda j: grid(ask_block, j))).alias("block"))
    against = rows.select("grp", "node", "cls", F.lit(False).alias("asked"), F.explode(F.transform(F.sequence(F.lit(0).cast("long"), n_ask - 1), lambda i: grid(i, all_block))).alias("block"))
    pairs = asked.union(against).groupBy("grp", "block", "node", "cls").agg(F.max("asked").alias("asked"))
    pairs = pairs.join(texts, "node")
    cross = written(pairs.groupBy("grp", "block").applyInArrow(_cross_links, _LINKS_DDL), "cross-links")
    return links.union(cross.select("a", "b"))


#: The rows of ``near_duplicates`` of the table documents by comparing all texts that share a shingle.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' '))) END AS s FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared s JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * s.n >= 75 * (p.n + q.n - s.n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, node) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.node)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
