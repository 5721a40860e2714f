"""The prefix trie of conversations, built level by level.

A turn is known by the SHA-256 of its role and text.  Per depth, the live conversations are grouped by
(parent node, next turn), and the least conv_id of a group names its node; joins give it to the members.
A group whose members all go on alike (one of them, or copies: told by a fingerprint of the whole
sequence) leaves the loop with its node: what follows is a chain, written down at once.  So the loop ends
at the deepest node where conversations part, however long they are.  Then levels are joined in reverse,
from children to parents, to add up leaves, children and savings.

Every grouping is a partial aggregate, and joins broadcast the hot nodes (see ``hot``).  The ids of the
conversations that end in one node are hashed as a sorted stream, in one task a node but never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written
from plumbline.llm.hot import join_shared

#: Conversations with ids of one group share the beginning of the first; so many turns at most.
GROUP, SHARED = 20, 3
_NOTHING = hashlib.sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest, words of each turn; null roles and texts are empty, rows without a conv_id go."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(whole, 256)).alias("digest"), words.alias("words")
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each row among its conversation's rows of this (sorted) partition, from 1."""
    part = TaskContext.get().partitionId()
    last, seen = None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy()
        if not len(conv):
            continue
        begin = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        place = np.arange(1, len(conv) + 1) - np.repeat(begin, np.diff([*begin, len(conv)]))
        if last == conv[0]:
            place[: begin[1] if len(begin) > 1 else len(conv)] += seen
        last, seen = int(conv[-1]), int(place[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(place, pa.int64()), batch.column(1), batch.column(2), pa.array(np.full(len(conv), part), pa.int64())],
            ["conv_id", "place", "digest", "words", "part"],
        )


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1, by turn with nulls first, then digest), digest, words.

    One range sort: a conversation may fill many partitions.  Only those at the edges of partitions can lie
    in several, at most two a partition; how many of their rows come before is broadcast.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "words")
    rows = written(ordered.mapInArrow(_numbered, "conv_id long, place long, digest binary, words long, part long"), "turns")
    ends = rows.groupBy("part").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b"))
    edges = ends.select(F.explode(F.array("a", "b")).alias("conv_id")).distinct()
    counts = rows.join(F.broadcast(edges), "conv_id", "left_semi").groupBy("conv_id", "part").count()
    before = F.sum("count").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = written(counts.select("conv_id", "part", before.alias("before")).where("before > 0"), "offsets")
    return rows.join(F.broadcast(offsets), ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "words")


def _head(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(SHARED + 1)).cast("long")


def rebuilt(turns: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, words) and (conv_id) of the conversations that share their group's beginning.

    Of ``turns`` (conv_id, place, digest, words): conversation c has the first h turns of c - c % ``GROUP``
    (all if fewer), then its own after its first h; h is the CRC-32 of its id, modulo ``SHARED`` + 1.
    """
    base = (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")
    turns = turns.withColumn("base", base)
    own = F.count_if(F.col("conv_id") == F.col("base"))
    bases = written(turns.groupBy("base").agg(F.least(own, F.lit(SHARED)).alias("has"), F.count("*").alias("rows")), "bases")
    late = join_shared(turns.where(F.col("place") > _head(F.col("conv_id"))), bases, ["base"], "rows", total)
    late = late.select("conv_id", (F.col("place") - _head(F.col("conv_id")) + F.least(_head(F.col("conv_id")), "has")).alias("depth"), "digest", "words")
    convs = turns.where("place = 1").select("conv_id", "base")
    heads = turns.where((F.col("conv_id") == F.col("base")) & (F.col("place") <= SHARED)).select("base", F.col("place").alias("depth"), "digest", "words")
    early = convs.join(heads, "base").where(F.col("depth") <= _head(F.col("conv_id"))).select("conv_id", "depth", "digest", "words")
    return early.unionByName(late), convs.select("conv_id")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined conv_ids of each run of (node, depth)."""
    held, hashed = None, hashlib.sha256()
    done: list[tuple[int, int, str]] = []
    for batch in batches:
        node, depth, conv = (batch.column(c).to_numpy() for c in range(3))
        if not len(node):
            continue
        cut = np.flatnonzero((node[1:] != node[:-1]) | (depth[1:] != depth[:-1])) + 1
        for a, b in zip([0, *cut], [*cut, len(node)], strict=True):
            ids = ",".join(map(str, conv[a:b].tolist())).encode()
            key = (int(node[a]), int(depth[a]))
            if key == held:
                hashed.update(b"," + ids)
                continue
            if held is not None:
                done.append((*held, hashed.hexdigest()))
            held, hashed = key, hashlib.sha256(ids)
        if len(done) > 10_000:
            yield _digests(done)
            done = []
    if held is not None:
        done.append((*held, hashed.hexdigest()))
    if done:
        yield _digests(done)


def _digests(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
    node, depth, ends = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(depth, pa.int64()), pa.array(ends)], ["node", "depth", "ends_sha256"])


def trie(sequences: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of ``sequences`` (conv_id, depth from 1, digest, words), whose members are ``conversations``
    (conv_id, distinct; those without a row in ``sequences`` are turnless).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; no
    conversations, no nodes.
    """
    spark = sequences.sparkSession
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "depth", "digest"))  # noqa: E731
    whole = sequences.groupBy("conv_id").agg(F.max("depth").alias("len"), mark(1).alias("p"), mark(2).alias("q"))
    convs = written(conversations.join(whole, "conv_id", "left"), "conversations")
    top = convs.agg(F.min("conv_id").alias("root"), F.count("*").alias("n"), F.sum("len").alias("rows")).first()
    if not top.n:
        return spark.createDataFrame([], NODES)
    rows = written(sequences.repartitionByRange("depth", "conv_id"), "sequences")
    live = convs.where("len > 0").select("conv_id", F.lit(top.root).cast("long").alias("parent"), "len", "p", "q")
    levels: list[DataFrame] = []
    ends = [convs.where("len is null").select(F.lit(top.root).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"), "conv_id")]
    depth = 0
    while True:
        depth += 1
        level = written(live.join(rows.where(F.col("depth") == depth), "conv_id"), "level")
        held = level.count()
        if not held:
            break
        same = (F.min("p") == F.max("p")) & (F.min("q") == F.max("q"))
        groups = level.groupBy("parent", "digest").agg(
            F.min("conv_id").alias("node"), F.count("*").alias("n"), F.max("words").alias("words"), F.max("len").alias("len"), same.alias("alone")
        )
        groups = written(groups, "groups")
        levels.append(groups.select("parent", "node", "n", "words", "len", "alone"))
        shared = groups.where("n > 1").select("parent", "digest", "node", "n", "alone")
        members = written(join_shared(level.drop("words"), shared, ["parent", "digest"], "n", held).select("conv_id", "node", "len", "p", "q", "alone"), "members")
        done = members.where((F.col("len") == depth) | F.col("alone"))
        ends.append(done.select("node", F.col("len").alias("depth"), "conv_id"))
        live = members.where(~F.col("alone") & (F.col("len") > depth)).select("conv_id", F.col("node").alias("parent"), "len", "p", "q")
    return _with_ends(_rolled_up(levels, rows, top), ends)


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _chained(levels: list[DataFrame], rows: DataFrame, total: int) -> DataFrame:
    """The nodes of groups that go on alike, from where they left the loop (``since``) to their ends."""
    found = [g.where("alone").select(F.col("node").alias("conv_id"), F.lit(k + 1).cast("long").alias("since"), "parent", "n", "len") for k, g in enumerate(levels)]
    tops = found[0]
    for other in found[1:]:
        tops = tops.union(other)
    links = join_shared(rows, written(tops, "chains"), ["conv_id"], "len", total).where("depth >= since")
    left = F.sum("words").over(Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0))
    nodes = [
        "conv_id",
        "depth",
        F.when(F.col("depth") == F.col("since"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        (F.col("depth") < F.col("len")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
    ]
    single = links.where("n = 1").select(*nodes, F.lit(0).cast("long").alias("saved_tokens"), "since")
    copies = links.where("n > 1").withColumn("left", left).select(*nodes, ((F.col("n") - 1) * F.col("left")).alias("saved_tokens"), "since")
    return written(single.union(copies), "chain-nodes")


def _sums(children: DataFrame) -> DataFrame:
    """(up, n_children, n_leaves, saved): what the nodes of one depth add up to, by parent."""
    return children.groupBy(F.col("parent_conv_id").alias("up")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))


def _rolled_up(levels: list[DataFrame], rows: DataFrame, top) -> DataFrame:
    """Chains, then forks from their children, from the deepest level up to the root."""
    root = rows.sparkSession.range(1).select(
        F.lit(top.root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(top.n).cast("long").alias("n_convs")
    )
    if not levels:
        return root.select("*", *(F.lit(v).cast("long").alias(c) for c, v in (("n_children", 0), ("n_leaves", 1), ("saved_tokens", 0))))
    chains = _chained(levels, rows, top.rows)
    nodes, below = chains.drop("since"), None
    for depth in range(len(levels), -1, -1):
        children = chains.where((F.col("depth") == depth + 1) & (F.col("since") == F.col("depth"))).drop("since")
        up = _sums(children if below is None else children.union(below))
        forks = root.withColumn("words", F.lit(0)) if depth == 0 else levels[depth - 1].where("not alone").select(
            F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "words"
        )
        saved = F.col("saved") + (F.col("n_convs") - 1) * F.col("words")
        below = written(forks.join(up, F.col("conv_id") == F.col("up")).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens")), "forks")
        nodes = nodes.union(below)
    return nodes


def _with_ends(nodes: DataFrame, ends: list[DataFrame]) -> DataFrame:
    """The digests of the conversations that end in each node; nodes of one conversation know theirs."""
    every = ends[0]
    for other in ends[1:]:
        every = every.union(other)
    digests = every.repartition("node", "depth").sortWithinPartitions("node", "depth", "conv_id").select("node", "depth", "conv_id").mapInArrow(_ends, "node long, depth long, ends_sha256 string")
    alone = F.col("n_convs") == 1
    own = F.when(F.col("n_children") == 0, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(_NOTHING)
    single = nodes.where(alone).withColumn("ends_sha256", own)
    shared = nodes.where(~alone).join(digests.withColumnRenamed("depth", "at"), (F.col("conv_id") == F.col("node")) & (F.col("depth") == F.col("at")), "left")
    return single.unionByName(shared.select(*nodes.columns, F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256")))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the whole, rebuilt ``conversations`` (conv_id, turn, role, text), one row a node.

    Turns of one number are ordered by their digests; repeated rows are turns of their own.  Rows without a
    conv_id belong to no conversation.  An empty table has no nodes, not even a root; other columns are
    ignored; texts of any length count by their digests.
    """
    turns = placed(turn_rows(conversations))
    sequences, convs = rebuilt(turns, max(1, turns.count()))
    return trie(sequences, convs)


#: The rows of ``prefix_trie`` of the table conversations; h is worked out bit by bit.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id AS c, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, turn,
    len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) AS w FROM conversations WHERE conv_id IS NOT NULL
), placed AS (SELECT c, d, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) AS p FROM turns),
heads AS (
  SELECT c, c - c % 20 AS base, (xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: [CAST(ord(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)) % 4 AS h
  FROM (SELECT DISTINCT c FROM placed)
), early AS (SELECT heads.c, p AS depth, d, w FROM heads JOIN placed ON placed.c = base AND p <= h),
had AS (SELECT heads.c, h, (SELECT count(*) FROM early WHERE early.c = heads.c) AS n FROM heads),
rebuilt AS (SELECT * FROM early UNION ALL SELECT placed.c, p - h + n, d, w FROM placed JOIN had ON had.c = placed.c AND p > h),
whole AS (SELECT heads.c, coalesce(list(d ORDER BY depth) FILTER (d IS NOT NULL), []) AS ds, coalesce(list(w ORDER BY depth) FILTER (w IS NOT NULL), []) AS ws FROM heads LEFT JOIN rebuilt USING (c) GROUP BY heads.c),
prefixes AS (SELECT c, k AS depth, ds[1 : k] AS own, ds[1 : k - 1] AS up, CASE WHEN k > 0 THEN ws[k] ELSE 0 END AS w, len(ds) = k AS ends FROM whole, UNNEST(range(0, len(ds) + 1)) AS u(k)),
nodes AS (
  SELECT depth, own, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, max(w) AS w, bool_and(ends) AS leaf,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY depth, own
), inside AS (SELECT a.depth, a.own, b.leaf, (b.n_convs - 1) * b.w AS saved FROM nodes a JOIN nodes b ON b.depth >= a.depth AND b.own[1 : a.depth] = a.own),
sums AS (SELECT depth, own, count(*) FILTER (leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM inside GROUP BY depth, own)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.up = n.own) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (depth, own) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.own = n.up
"""
