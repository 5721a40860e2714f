"""Joins of many rows with one row per key, where a key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds at least this part of all rows: there are no more such keys than its inverse.
HOT = 10_000


def join_shared(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per value of ``keys``).

    ``weight`` is a column of ``groups`` whose sum over all groups is at most ``total``, and which tells how
    many rows share the key.  Groups of a weight of at least ``total / HOT`` are at most ``HOT`` in number,
    so they are broadcast and their rows stay where they are; the rows of all others are shuffled.
    """
    hot = groups.where(F.col(weight) * HOT >= total)
    cold = groups.where(F.col(weight) * HOT < total)
    shuffled = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(shuffled.join(cold.hint("merge"), keys))
