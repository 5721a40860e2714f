"""The audit: from a folder of configurations to verdicts, reports and fleet findings.

Every step is a table; those that several steps read are staged.  One device that can't be parsed gives
an error row and leaves the others alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import documents, fleet, identity, packs, parsing, report
from plumbline.operators.ledger import canonical_json
from plumbline.plans import rules
from plumbline.sources import artefacts, bundle
from plumbline.sources.tables import delete, discard, recorded, staged


@dataclass
class Audit:
    lines: DataFrame
    devices: DataFrame
    facts: DataFrame
    documents: DataFrame
    coverage: DataFrame
    findings: DataFrame
    salt: bytes = b"local"
    members: DataFrame | None = None
    rule_set: str = ""
    folders: list[str] = field(default_factory=list, repr=False)

    @property
    def errors(self) -> DataFrame:
        return self.facts.where("path = '~error'").select("device_id", "file", F.col("value").alias("error"))

    def summary(self) -> DataFrame:
        return rules.summary(self.findings)

    def evidence(self) -> DataFrame:
        return documents.evidence(self.findings, self.facts, self.lines, self.salt)

    def reports(self) -> DataFrame:
        return report.audit_documents(self.findings, self.coverage, self.evidence(), self.rule_set)

    def discard(self) -> None:
        """Delete all that the audit and its correlations staged: the audit can't be read after this."""
        delete(self.lines.sparkSession, self.folders)
        self.folders.clear()

    def correlations(self) -> DataFrame:
        with recorded() as made:
            try:
                return fleet.correlations(self.documents, self.graph())
            finally:
                self.folders += made

    def graph(self) -> DataFrame:
        """The interfaces in their segments, staged once."""
        if self.members is None:
            with recorded() as made:
                self.members = fleet.graph(self.documents)
            self.folders += made
        return self.members

    def exit_code(self) -> int:
        return report.exit_code(self.findings).first().exit_code


def run(files: DataFrame, ruleset: list[rules.Rule] | None = None, salt: bytes = b"local", hold_out: tuple[str, ...] = (), learned: list[packs.Pack] | None = None) -> Audit:
    """Audit source files (device_id, file, role, text).  What a failed audit has staged is deleted."""
    with recorded() as made:
        try:
            result = _run(files, ruleset, salt, hold_out, learned)
        except BaseException:
            delete(files.sparkSession, made)
            raise
    result.folders = made
    return result


def _run(files: DataFrame, ruleset: list[rules.Rule] | None, salt: bytes, hold_out: tuple[str, ...], learned: list[packs.Pack] | None) -> Audit:
    lines = staged(bundle.lines(files), "lines")
    devices = staged(identity.identify(files, lines), "devices")
    if learned:  # a pack names devices that no signature knows
        own = packs.named(files, learned).select("device_id", F.col("vendor").alias("v"), F.col("os").alias("o"))
        lost = (F.col("vendor") == "unknown") & F.col("v").isNotNull()
        devices = staged(devices.join(own, "device_id", "left").withColumns({"vendor": F.when(lost, F.col("v")).otherwise(F.col("vendor")), "os": F.when(lost, F.col("o")).otherwise(F.col("os"))}).drop("v", "o"), "devices-named")
    facts = staged(parsing.parse(lines, devices, hold_out, salt).withColumns({"tier": F.lit(0), "confidence_bp": F.lit(10000), "pack": F.lit(None).cast("string")}), "facts")
    if learned:
        rest = documents.residue(packs.tree(lines.where("role = 'config'")), facts)
        facts = staged(facts.unionByName(packs.apply(rest, devices, learned)), "facts-learned")
    left = documents.residue(lines, facts)
    facts = staged(facts.unionByName(packs.structural(left)), "facts-claimed")
    docs = staged(documents.documents(facts.where("path is null or path <> '~error'"), devices), "documents")
    chosen = rules.SHIPPED if ruleset is None else ruleset
    found = staged(rules.findings(docs, chosen), "findings")
    return Audit(lines, devices, facts, docs, documents.coverage(lines, facts), found, salt, rule_set=rules.digest(chosen))


def audit(spark: SparkSession, path: str, **options) -> Audit:
    return run(bundle.load(spark, path), **options)


def device_files(result: Audit, audits: DataFrame) -> DataFrame:
    """name, value: ``<device>.ir.json`` and ``<device>.audit.json`` in canonical text (keys sorted, the same bytes
    for the same input) and ``<device>.md``."""

    def text(df: DataFrame) -> DataFrame:
        rows = df.withColumn("body", F.struct(*df.columns))
        return rows.select("device_id", canonical_json(F.col("body"), rows.schema["body"].dataType).alias("value"))

    name = lambda end: F.concat("device_id", F.lit(end)).alias("name")
    parts = [text(result.documents).select(name(".ir.json"), "value"), text(audits).select(name(".audit.json"), "value"), report.markdown(audits).select(name(".md"), F.col("report").alias("value"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def fleet_file(found: DataFrame) -> DataFrame:
    """name, value: the pieces of ``fleet.json``, an array of findings in canonical text, the most severe first.  It
    is one file by nature: one task sorts (and spills) and streams its lines, and holds none of them."""
    rows = found.withColumn("body", F.struct(*found.columns))
    line = canonical_json(F.col("body"), rows.schema["body"].dataType)
    pieces = rows.select(F.lit(False).alias("end"), report.severity_rank(F.col("severity")).alias("s"), "id", line.alias("text"))
    pieces = pieces.unionByName(found.sparkSession.range(1).select(F.lit(True).alias("end"), F.lit("]\n").alias("text")), allowMissingColumns=True)
    ordered = pieces.withColumn("n", F.row_number().over(W.orderBy("end", "s", "id", "text")))
    sign = F.when(F.col("n") == 1, "[").when(F.col("end"), "").otherwise(",\n")
    return ordered.select(F.lit("fleet.json").alias("name"), F.concat(sign, "text").alias("value"))


def write(result: Audit, path: str) -> None:
    """The artefacts: documents, audits and fleet findings as JSON (documents with their keys sorted), reports
    as text, coverage as a table, one folder each, and a file of each kind per device in ``devices``."""
    docs = result.documents.withColumn("body", F.struct(*result.documents.columns))
    docs.select("device_id", canonical_json(F.col("body"), docs.schema["body"].dataType).alias("value")).write.mode("overwrite").partitionBy("device_id").text(f"{path}/documents")
    audits = staged(result.reports(), "audits")
    audits.write.mode("overwrite").json(f"{path}/audits")
    report.markdown(audits).select("report", "device_id").write.mode("overwrite").partitionBy("device_id").option("lineSep", "\n\n").text(f"{path}/reports")
    result.coverage.write.mode("overwrite").parquet(f"{path}/coverage")
    artefacts.write_files(device_files(result, audits), f"{path}/devices")
    found = staged(result.correlations(), "correlations")
    found.write.mode("overwrite").json(f"{path}/fleet")
    report_text = fleet.report(found).select(F.lit("fleet.md").alias("name"), F.col("report").alias("value"))
    artefacts.write_files(fleet_file(found).unionByName(report_text), f"{path}/fleet-report")
    for df in (audits, found):
        discard(df)
