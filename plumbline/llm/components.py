"""Connected components of a link table, by contraction.

Each round hooks every node on the neighbour (or itself) that comes first in the order of the round,
replaces the links' ends by their hooks and drops what became a loop or a repeat.  Even rounds take
the order of the numbers, which ends stars around their least node at once; odd rounds take a random
order, in which an expected constant share of the nodes vanishes, also on long chains.  Hot nodes only
meet partial aggregates and joins that adaptive execution can split.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written


def components(links: DataFrame, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """``links`` (a long, b long) -> (node, component): the smallest node reachable.

    Nodes without links do not appear.  Loops, repeats and nulls in ``links`` are allowed; a link
    with a null end is no link.  An empty table gives an empty table.
    """
    edges = written(
        links.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        f"{name}-links",
    )
    hooks: list[DataFrame] = []
    for k in range(most_rounds):
        if edges.isEmpty():
            break
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        drawn = F.lit(0).cast("long") if k % 2 == 0 else None
        order = lambda c, k=k, d=drawn: F.struct((F.xxhash64(F.col(c), F.lit(k)) if d is None else d).alias("h"), F.col(c).alias("n"))
        hook = written(
            both.groupBy("node").agg(F.min(order("other")).alias("m")).select("node", F.least(F.col("m"), order("node")).getField("n").alias("to")),
            f"{name}-hooks",
        )
        hooks.append(hook)
        left, right = hook.select(F.col("node").alias("a"), F.col("to").alias("ta")), hook.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        edges = written(
            edges.join(left, "a").join(right, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(),
            f"{name}-round",
        )
    else:
        raise RuntimeError("the contraction did not end")
    spark = links.sparkSession
    if not hooks:
        return spark.createDataFrame([], "node long, component long")
    # A node kept by a round appears in the next hooks only if it still has links.
    resolved = hooks[-1].select("node", F.col("to").alias("root"))
    for hook in reversed(hooks[:-1]):
        later = resolved.select(F.col("node").alias("to"), "root")
        resolved = hook.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    resolved = written(resolved, f"{name}-roots")
    least = resolved.groupBy("root").agg(F.min("node").alias("component"))
    least = written(least, f"{name}-least")
    return resolved.join(least, "root").select("node", "component")
