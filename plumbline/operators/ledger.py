"""A hash-chained ledger of issued reports: canonical text, Merkle proofs, appending and verifying."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from plumbline.functions.ed25519 import SigningKey, verified
from plumbline.functions.scalars import leaf_hash
from plumbline.operators.relational import merkle_levels, merkle_root
from plumbline.sources.tables import spread

GENESIS = "0" * 64
ENTRY = "seq long, timestamp string, report_id string, device_id string, merkle_root string, prev_entry_hash string, rule_set_digest string, ir_schema_version string, canonicalisation string, signature string, key_id string"
SIGNED = ["seq", "timestamp", "report_id", "device_id", "merkle_root", "prev_entry_hash", "rule_set_digest", "ir_schema_version", "canonicalisation"]


class LedgerError(ValueError):
    """A ledger that can't be used."""


def canonical(value: object) -> bytes:
    """Sorted keys, no spaces, UTF-8 as it is; floats are refused because they print differently elsewhere."""

    def check(x: object) -> None:
        if isinstance(x, float):
            raise LedgerError("floats can't be hashed")
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, (list, tuple)) else ():
            check(y)

    check(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def entry_text(columns: list[str] = SIGNED) -> Column:
    """The canonical text of an entry's signed fields, as a column."""
    parts = []
    for k, c in enumerate(sorted(columns)):
        parts += [F.lit(("," if k else "{") + f'"{c}":'), F.expr(f"regexp_extract(to_json(named_struct('x', {c}), map('ignoreNullFields', 'false')), '(?s)^.{{5}}(.*).$', 1)")]
    return F.concat(*parts, F.lit("}"))


def entry_hash() -> Column:
    return F.sha2(entry_text().cast("binary"), 256)


def read(spark, path: str) -> DataFrame:
    """Entries of a JSON-lines ledger; a malformed line fails the read."""
    return spark.read.schema(ENTRY).option("mode", "FAILFAST").json(path)


def linked(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows with their place in the chain and the hash before them."""
    w = W.partitionBy(*keys).orderBy(order)
    return rows.withColumn("place", F.row_number().over(w)).withColumn("previous", F.lag("entry_hash").over(w))


def unsigned(entries: DataFrame, keys: dict[str, bytes]) -> DataFrame:
    """seq, problem of entries whose signature doesn't hold: there is none, its key isn't one of ``keys``
    (key id -> public key), or it is of another text.  Each entry is judged by itself; they are dealt over all
    cores, since a small file holds many and each costs far more than its move."""
    known = F.create_map(*(x for k, v in keys.items() for x in (F.lit(k), F.lit(v)))) if keys else F.create_map().cast("map<string,binary>")
    blank = F.coalesce(F.col("signature"), F.lit("")) == ""
    rows = spread(entries, "seq").withColumns({"public": known[F.coalesce(F.col("key_id"), F.lit(""))], "none": blank})
    rows = rows.withColumn("good", verified(entry_text().cast("binary"), F.unhex("signature"), F.col("public")))
    problem = F.when(F.col("none"), "unsigned").when(F.col("public").isNull(), "signed by a key that isn't known").when(~F.col("good"), "the signature doesn't verify")
    return rows.select("seq", problem.alias("problem")).where("problem is not null")


def verify(entries: DataFrame, keys: dict[str, bytes] | None = None) -> DataFrame:
    """seq, problem for everything that is wrong: an entry that is there twice, one whose predecessor is
    missing, one that doesn't hold its predecessor's hash and, where public keys are given, a bad signature.

    Hashes are made in parallel, and an entry meets its predecessor by a join on the number before it, so no
    task holds the whole ledger.
    """
    chained = _chained(entries)
    return chained if keys is None else chained.unionByName(unsigned(entries, keys))


def _chained(entries: DataFrame) -> DataFrame:
    rows = entries.withColumn("entry_hash", entry_hash()).select("seq", "prev_entry_hash", "entry_hash")
    each = rows.groupBy("seq").agg(F.count("*").alias("times"), F.max("prev_entry_hash").alias("prev_entry_hash"), F.max("entry_hash").alias("entry_hash"))
    before = each.select((F.col("seq") + 1).alias("seq"), F.col("entry_hash").alias("previous"))
    both = each.join(before, "seq", "left")
    first = F.col("seq") == 1
    found = F.array(
        F.when(F.col("times") > 1, F.lit("the entry is there more than once")),
        F.when((F.col("seq") < 1) | (~first & F.col("previous").isNull()), F.concat(F.lit("entry "), (F.col("seq") - 1).cast("string"), F.lit(" is missing"))),
        F.when(F.col("prev_entry_hash") != F.when(first, F.lit(GENESIS)).otherwise(F.col("previous")), F.lit("the chain is broken")),
    )
    return both.select("seq", F.explode(F.filter(found, lambda p: p.isNotNull())).alias("problem"))


def canonical_json(column: Column, kind: DataType) -> Column:
    """The canonical text of a struct column of that type: keys sorted at every depth, nulls written."""

    def sort(c: Column, t: DataType) -> Column:
        if isinstance(t, StructType):
            made = F.struct(*(sort(c[f.name], f.dataType).alias(f.name) for f in sorted(t.fields, key=lambda f: f.name)))
            return F.when(c.isNotNull(), made)
        if isinstance(t, ArrayType) and isinstance(t.elementType, (StructType, ArrayType)):
            return F.transform(c, lambda x: sort(x, t.elementType))
        return c

    return F.to_json(sort(column, kind), {"ignoreNullFields": "false"})


def leaf_material(found: DataFrame, cited: DataFrame | None = None) -> DataFrame:
    """device_id, rule_id, material, leaf: what the ledger commits to for each finding: its verdict, state,
    severity, unresolved paths and the evidence, so that neither can be rewritten later."""
    piece = "array<struct<file:string,ir_path:string,line:int,raw:string>>"
    rows = found.select("device_id", "rule_id", "verdict", "state", "severity", F.col("unresolved").alias("missing_paths"))
    if cited is None:
        rows = rows.withColumn("evidence", F.array().cast(piece))
    else:
        one = F.struct("n", F.struct("file", "ir_path", F.col("line_no").alias("line"), "raw").alias("e"))
        held = cited.groupBy("device_id", "rule_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["e"]).cast(piece).alias("evidence"))
        rows = rows.join(held, ["device_id", "rule_id"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(piece)))
    body = F.struct("evidence", "missing_paths", "rule_id", "severity", "state", "verdict")
    text = rows.withColumn("body", body)
    return text.select("device_id", "rule_id", canonical_json(F.col("body"), text.schema["body"].dataType).alias("material")).withColumn("leaf", leaf_hash(F.col("material")))


def roots(leaves: DataFrame) -> DataFrame:
    """device_id, merkle_root over the leaves of a device in the order of their rules."""
    listed = leaves.groupBy("device_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_id", "leaf"))), lambda x: x["leaf"]).alias("l"))
    return listed.select("device_id", merkle_root(F.col("l")).alias("merkle_root"))


PROOF = "array<struct<left:boolean,hash:string>>"


def proofs(trees: DataFrame, keys: list[str], leaves: str = "leaves") -> DataFrame:
    """keys, at, leaf, root, proof of every leaf of every tree: the siblings on its way to the root.

    All levels of a tree are worked out once; a leaf's sibling on a level is the place beside its own, whose
    number halves from level to level.  An odd one that moves up has none there.  No task but that of the tree
    itself holds its leaves, and nothing comes to the driver.
    """
    rows = trees.where(F.size(leaves) > 0).select(*keys, merkle_levels(F.col(leaves)).alias("levels"))
    each = rows.select(*keys, "levels", F.posexplode(F.get("levels", F.lit(0))).alias("at", "leaf"))
    half = lambda k, i: F.call_function("shiftright", k, i)

    def step(level, i):
        place = half(F.col("at"), i)
        beside = place.bitwiseXOR(F.lit(1))
        return F.struct((beside < place).alias("left"), F.get(level, beside).alias("hash"))

    below = F.slice("levels", F.lit(1), F.size("levels") - 1)
    found = F.filter(F.transform(below, step), lambda s: s["hash"].isNotNull())
    return each.select(*keys, "at", "leaf", F.get(F.element_at("levels", -1), F.lit(0)).alias("root"), found.alias("proof"))


def proves(leaf: Column, proof_: Column, root: Column) -> Column:
    """Whether the siblings lead from a leaf to a root; a null leaf or root is never proved."""
    pair = lambda a, b: F.sha2(F.concat(F.lit(b"\x01"), F.unhex(a), F.unhex(b)), 256)
    top = F.aggregate(proof_, leaf, lambda h, s: F.when(s["left"], pair(s["hash"], h)).otherwise(pair(h, s["hash"])))
    return F.coalesce(top == root, F.lit(False))


def finding_proofs(leaves: DataFrame) -> DataFrame:
    """device_id, rule_id, leaf, root, proof of every finding of a fleet, as ``roots`` orders the leaves."""
    rows = F.array_sort(F.collect_list(F.struct("rule_id", "leaf")))
    trees = leaves.groupBy("device_id").agg(rows.alias("rows")).select("device_id", F.transform("rows", lambda x: x["rule_id"]).alias("rules"), F.transform("rows", lambda x: x["leaf"]).alias("leaves"))
    made = proofs(trees, ["device_id", "rules"])
    return made.select("device_id", F.get("rules", F.col("at")).alias("rule_id"), "leaf", "root", "proof")


def record(spark: SparkSession, path: str, reports: list[dict], key: SigningKey | None = None) -> list[dict]:
    """Append entries of a batch of reports to the ledger in ``path`` (JSON lines) and return them, signed if
    there is a key.

    One writer at a time: the head is read, the new entries are chained to it on the driver, and they become
    visible as one file.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    head = [r.asDict() for r in read(spark, path).orderBy(F.col("seq").desc()).limit(1).collect()] if there else []
    made = append(head, reports, key)
    spark.createDataFrame([tuple(e.get(c.split()[0]) for c in ENTRY.split(", ")) for e in made], ENTRY).coalesce(1).write.mode("append").json(path)
    return made


def short_hash(text: Column) -> Column:
    """The sixteen letters that a report prints of an entry's hash."""
    return F.left(text, F.lit(16))


def append(entries: list[dict], reports: list[dict], key: SigningKey | None = None) -> list[dict]:
    """New entries behind the old ones, of which only the last is needed: serial by nature, so it runs on the
    driver over one batch; so do signatures, because the key stays there."""
    at = entries[-1]["seq"] if entries else 0
    out, head = [], hashlib.sha256(canonical({k: entries[-1][k] for k in SIGNED})).hexdigest() if entries else GENESIS
    for k, r in enumerate(reports, at + 1):
        entry = {"canonicalisation": "jcs-1", **r, "seq": k, "prev_entry_hash": head}
        head = hashlib.sha256(canonical({k: entry[k] for k in SIGNED})).hexdigest()
        out.append({"signature": "", "key_id": "", **entry})
    if key is not None:
        name = key.key_id
        for entry, signature in zip(out, key.sign_all([canonical({k: e[k] for k in SIGNED}) for e in out]), strict=True):
            entry |= {"signature": signature.hex(), "key_id": name}
    return out


def proof(leaves: list[str], at: int) -> list[tuple[str, str]]:
    """Siblings (side, hash) from a leaf to the root."""
    out, level = [], leaves
    while len(level) > 1:
        other = at ^ 1
        if other < len(level):
            out.append(("left" if other < at else "right", level[other]))
        level = [hashlib.sha256(b"\x01" + bytes.fromhex(level[k]) + bytes.fromhex(level[k + 1])).hexdigest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        at //= 2
    return out


def root_of(leaves: list[str]) -> str:
    level = leaves or [hashlib.sha256(b"").hexdigest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + bytes.fromhex(level[k]) + bytes.fromhex(level[k + 1])).hexdigest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def included(leaf: str, steps: list[tuple[str, str]], root: str) -> bool:
    for side, other in steps:
        a, b = (other, leaf) if side == "left" else (leaf, other)
        leaf = hashlib.sha256(b"\x01" + bytes.fromhex(a) + bytes.fromhex(b)).hexdigest()
    return leaf == root
