"""From raw documents to token ids: rules, classifier, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the
last return the columns of ``documents``.  What is learned, is learned from the labels of the whole
``documents`` table, so that a filter before a stage does not take its examples away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from plumbline.llm import attention, bpe, decontaminate, neardup, rules
from plumbline.llm.common import read_table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rule and the learned decision list keep."""
    known = rules.learn_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return rules.kept_rows(docs, known)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the attention network takes for good; null and empty texts are bags of one empty passage,
    repeated rows stay or go together, and without labels all rows stay."""
    return attention.kept_rows(docs, read_table(spark, sf_dir, "labels"), read_table(spark, sf_dir, "documents"))


def first_row(docs: DataFrame, key: str) -> DataFrame:
    """One row per value of ``key``: the least by text, then by the other columns that have an order."""
    own = [c for c in dict.fromkeys(("text", *docs.columns)) if c != key]
    slots = [f"c{k}" for k in range(len(own))]
    plain = docs.select(F.col(f"`{key}`").alias("key"), *(F.col(f"`{c.replace('`', '``')}`").alias(s) for s, c in zip(slots, own, strict=True)))
    ordered = [s for s in slots if not isinstance(plain.schema[s].dataType, (MapType, VariantType))]
    least = F.min(F.struct(*slots)) if ordered == slots else F.min_by(F.struct(*slots), F.struct(*ordered))
    found = plain.groupBy("key").agg(least.alias("row"))
    return found.select(*((F.col("key") if c == key else F.col(f"row.{slots[own.index(c)]}")).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id; of rows with that id the least by text.

    Rows without an id stay once per text: they can't be told apart otherwise.  An empty table stays empty.
    """
    found = neardup.near_duplicates(docs.select("doc_id", "text")).where("kept and doc_id is not null")
    kept = written(found.select("doc_id").distinct(), "kept-ids")
    some = first_row(docs.join(kept.hint("merge"), "doc_id", "left_semi"), "doc_id")
    return some.unionByName(first_row(docs.where("doc_id is null"), "text"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of a benchmark item; null and empty texts, and all rows beside an empty
    benchmark, stay."""
    return decontaminate.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and token_ids of every row; a null text has no tokens."""
    return bpe.digests(bpe.encode(docs), "token_ids")


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("bpe encoding", bpe_encoding),
]

#: SQL expresses neither the network nor the automaton; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; an empty table passes through."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), "snappy")
    return docs
