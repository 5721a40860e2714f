"""Nested documents as indexed paths: ``interfaces[1].acl_in``, ``acls[0].entries[2].action``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

#: Lists whose members are facts of their own.
MEMBERS = ["interfaces", "aaa.local_users"]


def depth_of(kind: DataType) -> int:
    """How many times a value of this type must be opened until only plain values and lists of them are left."""
    if isinstance(kind, StructType):
        return 1 + max((depth_of(f.dataType) for f in kind.fields), default=0)
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
        return 1 + depth_of(kind.elementType)
    return 0


def _opens(v: Column) -> Column:
    """Objects and lists of objects are opened; lists of plain values are values."""
    return F.schema_of_variant(v).rlike("^(OBJECT|ARRAY<(OBJECT|VARIANT))")


def _opened(rows: DataFrame, keys: list[str]) -> DataFrame:
    inside = rows.withColumn("inside", F.when(_opens(F.col("v")), F.col("v")))
    step = inside.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("inside").outer()))
    name = F.when(F.col("key").isNotNull(), F.concat(F.when(F.col("ir_path") == "", "").otherwise("."), "key")).when(F.col("pos").isNotNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise("")
    return step.select(*keys, F.concat("ir_path", name).alias("ir_path"), F.coalesce("value", "v").alias("v"))


def flattened(docs: DataFrame, keys: list[str], variant: Column, depth: int | None = None) -> DataFrame:
    """keys, ir_path, value (text) of every plain value inside ``variant``; nulls have no row.

    Each step opens one level by a lateral generator, without a shuffle; values that are plain pass.  Lists of
    plain values are joined by commas.  Without ``depth`` a look at the rows tells when nothing is left to open.
    """
    rows = docs.select(*keys, F.lit("").alias("ir_path"), variant.alias("v"))
    for _ in range(4 if depth is None else depth):
        rows = _opened(rows, keys)
    while depth is None and not rows.where(_opens(F.col("v"))).isEmpty():
        rows = _opened(rows, keys)
    listed = F.array_join(F.try_variant_get("v", "$", "array<string>"), ",")
    value = F.when(F.schema_of_variant("v").startswith("ARRAY"), listed).otherwise(F.try_variant_get("v", "$", "string"))
    return rows.select(*keys, "ir_path", value.alias("value")).where("value is not null")


def document_paths(docs: DataFrame, key: str = "device_id") -> DataFrame:
    """key, ir_path, value of documents: all columns but the key, of any types."""
    body = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != key))
    kind = StructType([f for f in docs.schema.fields if f.name != key])
    return flattened(docs, [key], F.to_variant_object(body), depth_of(kind))


def json_paths(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The same of documents in a column of JSON text, whatever is in them; what doesn't parse has no paths."""
    return flattened(docs.where(F.try_parse_json(text).isNotNull()), [key], F.try_parse_json(text))


def indexed(facts: DataFrame) -> DataFrame:
    """``facts`` with their paths (device_id, ir_path, op, value, file, line_no, sub), members with their index.

    Members are counted as a document lists them: by file, then by the line that they begin at; entries within
    their list.  An account's secret is known by its fingerprint; entries without a number count in tens.
    """
    own = ["device_id", "ir_path", "op", "value", "file", "line_no", "sub"]
    at = lambda base, i: F.concat(F.lit(f"{base}["), i.cast("string"), F.lit("]"))
    flat = facts.where("path is not null and entity is null").withColumn("ir_path", F.col("path")).select(*own)
    members = facts.where("path is not null and entity is not null")
    parts = [flat]
    for base in MEMBERS:
        of = members.where(F.col("path").startswith(f"{base}."))
        k = F.dense_rank().over(W.partitionBy("device_id").orderBy("file", "entity")) - 1
        of = of.withColumn("at", at(base, k))
        leaf = F.substring("path", F.lit(len(base) + 1), F.length("path"))
        parts.append(of.withColumn("ir_path", F.concat("at", leaf)).select(*own))
        if base == "aaa.local_users":
            parts.append(of.where("secret is not null").withColumns({"ir_path": F.concat("at", F.lit(".hash_fingerprint")), "value": F.col("secret"), "op": F.lit("set")}).select(*own))
    lists = members.where("path = 'acls.name'")
    k = F.dense_rank().over(W.partitionBy("device_id").orderBy("file", "entity")) - 1
    lists = lists.withColumn("at", at("acls", k))
    parts.append(lists.withColumn("ir_path", F.concat("at", F.lit(".name"))).select(*own))
    j = F.row_number().over(W.partitionBy("device_id", "file", "acl").orderBy("entity")) - 1
    entries = members.where("path = 'acls.entries.acl'").select("device_id", "file", "entity", F.col("value").cast("int").alias("acl")).dropDuplicates(["device_id", "file", "entity"]).withColumn("j", j)
    held = lists.select("device_id", "file", F.col("entity").alias("acl"), "at").dropDuplicates(["device_id", "file", "acl"])
    entries = entries.join(held, ["device_id", "file", "acl"]).select("device_id", "file", "entity", "j", "at")
    of = members.where("path like 'acls.entries.%' and path <> 'acls.entries.acl'").join(entries, ["device_id", "file", "entity"])
    leaf = F.substring("path", F.lit(len("acls.entries") + 1), F.length("path"))
    value = F.when((F.col("path") == "acls.entries.seq") & F.col("value").isNull(), ((F.col("j") + 1) * 10).cast("string")).otherwise(F.col("value"))
    parts.append(of.withColumns({"ir_path": F.concat("at", F.lit(".entries["), F.col("j").cast("string"), F.lit("]"), leaf), "value": value}).select(*own))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every
