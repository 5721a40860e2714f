"""Many benchmarks at once: files to controls on executors, bindings joined to them, rules and a catalogue as tables.

A benchmark is one XML document, which needs a stack, so each file is read by one task; files are spread over all.  A
file that can't be read is one row with ``error`` and leaves the others alone.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.rules import Rule, RuleError
from plumbline.sources.xccdf import COLUMNS, Binding, controls

#: Fixed: larger files aren't benchmarks.  Bindings of up to so many bytes are broadcast.
MOST_BYTES, BROADCAST_BYTES = 64 << 20, 64 << 20
PARSED = f"file string, place int, {COLUMNS}, error string"
FIXES = "array<struct<vendor:string,steps:array<string>>>"
_BOUND = f"kind string, name string, at int, assertion string, own_severity string, fixes {FIXES}, own_frameworks array<string>, vendors array<string>, roles array<string>, problem string"


def files(spark: SparkSession, path: str) -> DataFrame:
    """file, content, size of the files below a path; the content of those over ``MOST_BYTES`` isn't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = found.where(F.col("length") <= MOST_BYTES).select(F.col("path").alias("file"), "content", F.col("length").alias("size"))
    large = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") > MOST_BYTES)
    return small.unionByName(large.select(F.col("path").alias("file"), F.lit(None).cast("binary").alias("content"), F.col("length").alias("size")))


def _text(content: bytes) -> str:
    """A file's text; of a zip archive, its first member (by name) that ends in xccdf.xml."""
    if content[:2] != b"PK":
        return content.decode("utf-8-sig", errors="replace")
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        name = next((n for n in sorted(archive.namelist()) if n.lower().endswith("xccdf.xml")), None)
        if name is None:
            raise RuleError("the archive holds no benchmark")
        if archive.getinfo(name).file_size > MOST_BYTES:
            raise RuleError("the benchmark is too large")
        return archive.read(name).decode("utf-8-sig", errors="replace")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in PARSED.split(", ")]
    for batch in batches:
        for file, content, size in zip(batch["file"], batch["content"], batch["size"], strict=True):
            try:
                if content is None or size > MOST_BYTES:
                    raise RuleError("the benchmark is too large" if size > MOST_BYTES else "the benchmark has no text")
                rows = [(file, k, *row, None) for k, row in enumerate(controls(_text(bytes(content))))]
            except (RuleError, zipfile.BadZipFile) as e:
                rows = [(file, 0, *[None] * (len(names) - 3), str(e).split(":")[0])]
            yield pd.DataFrame(rows, columns=names).astype({"place": "int32"})


def parse(found: DataFrame) -> DataFrame:
    """The rows of ``PARSED``: controls of benchmark files (file, and text, or content with size), in their order.

    Null and empty texts, archives without a benchmark, document types, bad XML and files without controls give one
    row with ``error``.  Other columns are left out; a file that comes twice is read twice."""
    rows = found if "content" in found.columns else found.withColumn("content", F.encode("text", "utf-8")).withColumn("size", F.octet_length("content"))
    return rows.select("file", "content", F.coalesce("size", F.lit(0)).cast("long").alias("size")).mapInPandas(_read, PARSED)


def binding_rows(bindings: list[Binding], known: list[Rule]) -> list[tuple]:
    """Bindings by the lower-case names of the controls that they mean: of a name, the first binding."""
    by_id = {r.id: r for r in known}
    first: dict[tuple[str, str], tuple] = {}
    for place, b in enumerate(bindings):
        source = by_id.get(b.remediation_from) if b.remediation_from else None
        problem = f"remediation of unknown rule {b.remediation_from}" if b.remediation_from and source is None else None
        fixes = [(k, list(v)) for k, v in (source.remediation if source else b.remediation).items()]
        for kind, name in (("stig", b.stig_id), ("vuln", b.vuln_id)):
            if name:
                first.setdefault((kind, name.lower()), (kind, name.lower(), place, b.assertion, b.severity, fixes, list(b.frameworks), list(b.vendors), list(b.roles), problem))
    return list(first.values())


def clean_id(text: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", ""), F.lit(64))


def bind(parsed: DataFrame, bindings: list[Binding], known: list[Rule]) -> DataFrame:
    """The catalogue: every control with ``bound``, ``status`` and, where bound, the rule that a binding makes of it
    (rule, assertion, rule_severity, frameworks, fixes, vendors, roles).

    The first binding that names the control by either id counts, whatever the case.  Commands are those of the rule
    that the binding names, else its own, else the benchmark's text as a manual step; ``problem`` tells of a binding
    that names an unknown rule.  Two lookups by equal names, no shuffle while the bindings are broadcast."""
    made = binding_rows(bindings, known)
    table = parsed.sparkSession.createDataFrame(made, _BOUND)
    if sum(len(str(x)) for row in made for x in row) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    out = parsed.where("error is null")
    for kind in ("stig", "vuln"):
        one = table.where(F.col("kind") == kind).select(F.col("name").alias(f"{kind}_name"), F.struct("at", "assertion", "own_severity", "fixes", "own_frameworks", "vendors", "roles", "problem").alias(f"{kind}_hit"))
        out = out.join(one, F.lower(f"{kind}_id") == F.col(f"{kind}_name"), "left").drop(f"{kind}_name")
    hit = F.array_min(F.array_compact(F.array("stig_hit", "vuln_hit")))
    out = out.withColumn("hit", hit).withColumn("bound", F.col("hit").isNotNull())
    name = F.when(F.col("stig_id") == "", F.col("vuln_id")).otherwise(F.col("stig_id"))
    by_hand = F.array(F.struct(F.lit("manual").alias("vendor"), F.array(F.when(F.col("fix") == "", "See the benchmark fix text.").otherwise(F.col("fix"))).alias("steps")))
    listed = F.concat(F.array(F.concat(F.lit("STIG:"), name), F.concat(F.lit("STIG-VULN:"), "vuln_id")), F.transform("ccis", lambda c: F.concat(F.lit("CCI:"), c)), "hit.own_frameworks")
    on = lambda c: F.when(F.col("bound"), c)
    return out.select(
        *[c.split()[0] for c in PARSED.split(", ")[:-1]], "bound", F.when(F.col("bound"), "evaluated").otherwise("manual review").alias("status"), on(clean_id(name)).alias("rule"), F.col("hit.assertion").alias("assertion"),
        on(F.when(F.col("hit.own_severity") != "", F.col("hit.own_severity")).otherwise(F.col("severity"))).alias("rule_severity"), on(listed).alias("frameworks"),
        on(F.when(F.size("hit.fixes") > 0, F.col("hit.fixes")).otherwise(by_hand)).alias("fixes"), F.col("hit.vendors").alias("vendors"), F.col("hit.roles").alias("roles"), F.col("hit.problem").alias("problem"),
    )


def counts(bound: DataFrame) -> DataFrame:
    """Controls per file and severity, and how many of them a machine checks."""
    return bound.groupBy("file", "severity").agg(F.count("*").alias("controls"), F.count_if("bound").alias("checked"))


def write(bound: DataFrame, path: str) -> None:
    """Rules and the catalogue as folders of JSON lines.  A binding that names an unknown rule fails the import."""
    sure = bound.withColumn("rule", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(": ", "stig_id", "problem")).cast("string")).otherwise(F.col("rule")))
    fixes = F.map_from_entries("fixes")
    rule = sure.where("bound").select(F.col("rule").alias("id"), F.col("rule_severity").alias("severity"), "assertion", "title", "frameworks", F.when(F.col("discussion") == "", F.col("title")).otherwise(F.col("discussion")).alias("rationale"), fixes.alias("remediation"), "vendors", "roles", "file")
    rule.write.mode("overwrite").json(f"{path}/rules")
    sure.select("file", "place", *[c.split()[0] for c in COLUMNS.split(", ")], "bound", "status", "rule").write.mode("overwrite").json(f"{path}/catalogue")
