"""What moved between two audits of a device: verdicts and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import relational
from plumbline.operators.paths import document_paths, indexed, json_paths


class DriftError(ValueError):
    """Two audits that can't be compared."""


def same_devices(before: DataFrame, after: DataFrame) -> None:
    """Refuses tables that hold different devices."""
    a, b = before.select("device_id").distinct(), after.select("device_id").distinct()
    lost = a.join(b, "device_id", "left_anti").union(b.join(a, "device_id", "left_anti"))
    first = lost.first()
    if first is not None:
        raise DriftError(f"{first.device_id} is on one side only")


def verdict_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """device_id, rule_id, before, after, change; a rule out of scope is absent, as a report leaves it out."""
    key = F.concat_ws("\x1f", "device_id", "rule_id")
    cut = lambda df: df.where("verdict <> 'not_applicable'").select(key.alias("key"), "verdict")
    out = relational.drift(cut(before), cut(after), "key", "verdict")
    return out.select(F.split_part("key", F.lit("\x1f"), F.lit(1)).alias("device_id"), F.split_part("key", F.lit("\x1f"), F.lit(2)).alias("rule_id"), "before", "after", "change")


def fact_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """device_id, ir_path, before, after, line of facts whose value differs; a missing fact is null.

    Members of lists are compared index by index: interfaces, accounts, access lists and their entries.  The
    line is that of the later audit, null for what is gone.
    """

    def values(facts: DataFrame, name: str) -> DataFrame:
        order = F.struct("file", "line_no", "sub")
        own = indexed(facts).groupBy("device_id", "ir_path")
        last = F.when(F.max("op") == "set", F.max_by("value", order))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "value"))), lambda x: x["value"]), ",")
        return own.agg(F.when(F.max("op") == "set", last).otherwise(joined).alias(name), F.max("line_no").alias(f"{name}_line"))

    both = values(before, "before").join(values(after, "after"), ["device_id", "ir_path"], "full")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select("device_id", "ir_path", "before", "after", F.col("after_line").alias("line"))


AUDIT = "device_id string, rule_set string, findings array<struct<rule_id:string,verdict:string>>, passed array<string>"


def written_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """device_id, rule_set, rule_id, verdict of audits that were written as JSON."""
    rows = spark.read.schema(AUDIT).option("mode", "FAILFAST").json(path)
    none = F.array().cast("array<struct<rule_id:string,verdict:string>>")
    held = F.transform(F.coalesce("passed", F.array().cast("array<string>")), lambda r: F.struct(r.alias("rule_id"), F.lit("pass").alias("verdict")))
    return rows.select("device_id", "rule_set", F.explode(F.concat(F.coalesce("findings", none), held)).alias("v")).select("device_id", "rule_set", "v.*")


def rules_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """device_id of devices whose two audits were made with different rule sets."""
    one = lambda df, name: df.groupBy("device_id").agg(F.max("rule_set").alias(name))
    return one(before, "a").join(one(after, "b"), "device_id").where(~F.col("a").eqNullSafe(F.col("b"))).select("device_id")


def document_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """device_id, ir_path, before, after of two tables of documents, at any depth and index; null where a side has
    no such value."""
    a, b = document_paths(before).withColumnRenamed("value", "before"), document_paths(after).withColumnRenamed("value", "after")
    return a.join(b, ["device_id", "ir_path"], "full").where(~F.col("before").eqNullSafe(F.col("after")))


def written_document_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """The same of documents that were written as JSON (device_id, value), whatever their schema was."""
    a, b = (json_paths(df, "device_id", "value") for df in (before, after))
    return a.withColumnRenamed("value", "before").join(b.withColumnRenamed("value", "after"), ["device_id", "ir_path"], "full").where(~F.col("before").eqNullSafe(F.col("after")))
