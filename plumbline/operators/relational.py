"""Relational operators of the engine, for any table: what the catalogue and the device pipeline share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.sources.tables import staged


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in an order that has no ties."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def carried(df: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The last non-null value at or above each row: a block header's reach over the lines below it."""
    return df.withColumn(name, F.last(value, True).over(W.partitionBy(*keys).orderBy(order)))


def window_of(df: DataFrame, hits: DataFrame, keys: list[str], order: str, radius: int, name: str = "hit") -> DataFrame:
    """Rows within ``radius`` of a hit in the same group, by an equi-join on the places around it."""
    spread = hits.select(*keys, F.col(order).alias(name), F.explode(F.sequence(F.col(order) - radius, F.col(order) + radius)).alias(order))
    return spread.join(df, [*keys, order])


def pairs_within(df: DataFrame, key: str, ident: str, most: int | None = None) -> DataFrame:
    """Unordered pairs (a, b, key) of rows that share a key, each once.

    ``most`` guards against a key whose pairs would be the square of a large group: such keys raise
    rather than being cut.
    """
    if most is not None:
        sizes = df.groupBy(key).count()
        df = df.join(sizes.withColumn("__ok", F.when(F.col("count") > most, F.raise_error(F.lit(f"a group of {key} is too large for pairs"))).otherwise(True)).drop("count"), key).drop("__ok")
    left, right = df.select(key, F.col(ident).alias("a")), df.select(key, F.col(ident).alias("b"))
    return left.join(right, key).where("a < b")


def first_band(values: DataFrame, bands: DataFrame, value: str, order: str = "ord") -> DataFrame:
    """Each value with the first declared band (lo, hi, ord, band) that holds it; null where none does.

    Bands are declared by people and few; they become one column expression, so no join is needed and
    nothing grows with the values.
    """
    out: Column = F.lit(None).cast("string")
    rows = sorted(bands.limit(10_001).collect(), key=lambda r: r[order], reverse=True)
    if len(rows) > 10_000:
        raise ValueError("too many bands for one expression")
    for r in rows:
        out = F.when((F.col(value) >= r.lo) & (F.col(value) <= r.hi), r.band).otherwise(out)
    return values.withColumn("band", out)


def reach(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node, depth): every node within ``hops`` directed steps, with its least depth.

    Each front is staged, so a step reads the fronts before it and works none of them out again.
    """
    front = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    seen = front
    for d in range(1, hops + 1):
        step = front.join(edges, front["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        front = staged(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(d)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def drift(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, before, after, change of every key whose value differs, ``absent`` where a side lacks it."""
    a, b = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    both = a.join(b, key, "full").select(key, F.coalesce("before", F.lit("absent")).alias("before"), F.coalesce("after", F.lit("absent")).alias("after"))
    kind = (
        F.when((F.col("after") == "fail") & (F.col("before") != "fail"), "regression")
        .when((F.col("before") == "fail") & F.col("after").isin("pass", "not_applicable"), "improvement")
        .otherwise("other")
    )
    return both.where("before <> after").withColumn("change", kind)


def shares(column: Column, total: Column) -> Column:
    """Per cent, 0 where there is nothing."""
    return F.coalesce(F.try_divide(100.0 * column, total), F.lit(0.0))


def confusion(df: DataFrame, truth: Column, said: Column) -> DataFrame:
    """Counts and rates of a ternary prediction; null means that nothing was said.

    A fault that nothing was said about counts against recall as a cautious miss.
    """
    c = lambda x: F.count_if(x)
    t = df.agg(
        c(truth & said).alias("tp"), c(~truth & said).alias("fp"), c(truth & ~said).alias("fn"), c(truth & said.isNull()).alias("cautious"), c(~truth & ~said).alias("tn"), F.count("*").alias("n"), c(said.isNull()).alias("unsaid")
    )
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    v = F.col
    return t.select(
        "tp", "fp", "fn", "cautious", "tn",
        F.bround(rate(v("tp"), v("tp") + v("fp")), 6).alias("precision"),
        F.bround(rate(v("tp"), v("tp") + v("fn") + v("cautious")), 6).alias("recall"),
        F.bround(rate(v("tp") + v("tn"), v("n")), 6).alias("agreement"),
        F.bround(rate(v("unsaid"), v("n")), 6).alias("unknown_rate"),
    )


def _paired(level: Column) -> Column:
    """The level above: pairs hash as 01 | left | right, an odd one moves up."""
    return F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(level) / 2).cast("int") - 1),
        lambda i: F.when(
            2 * i + 1 < F.size(level),
            F.sha2(F.concat(F.lit(b"\x01"), F.unhex(F.get(level, 2 * i)), F.unhex(F.get(level, 2 * i + 1))), 256),
        ).otherwise(F.get(level, 2 * i)),
    )


def _heights(leaves: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.size(leaves), F.lit(1)).cast("double"))).cast("int")))


def merkle_levels(leaves: Column) -> Column:
    """All levels of a tree, from the leaves to the root alone; of one leaf just that level."""
    up = lambda levels: F.concat(levels, F.array(_paired(F.element_at(levels, -1))))
    return F.aggregate(_heights(leaves), F.array(leaves), lambda levels, _: F.when(F.size(F.element_at(levels, -1)) > 1, up(levels)).otherwise(levels))


def merkle_root(leaves: Column) -> Column:
    """Root over an array of leaf hashes in hex; of no leaves the hash of nothing."""
    folded = F.aggregate(_heights(leaves), leaves, lambda level, _: F.when(F.size(level) > 1, _paired(level)).otherwise(level))
    return F.when(F.size(leaves) == 0, F.sha2(F.lit(b""), 256)).otherwise(F.get(folded, F.lit(0)))
