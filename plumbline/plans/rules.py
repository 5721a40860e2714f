"""Rules: loading, scope, and their evaluation as one projection over device documents."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from plumbline.functions.reuse import per_session
from plumbline.operators.ledger import canonical_json
from plumbline.plans.assertions import Compiler, parse
from plumbline.plans.shipped import COMMANDS, RULES, WORDS

#: Fixed: severities from worst to least.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
#: Fixed: where remediation commands of a vendor are looked up, in this order.
TARGETS = {
    "cisco": ["cisco_ios"],
    "arista": ["arista_eos", "cisco_ios"],
    "juniper": ["juniper", "junos"],
    "fortinet": ["fortios"],
    "mikrotik": ["routeros"],
    "paloalto": ["panos"],
    "vyos": ["vyos"],
}
REQUIRED = ["id", "title", "frameworks", "severity", "assert", "rationale", "remediation"]


class RuleError(ValueError):
    """A rule that can't be used."""


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    assertion: str
    title: str = ""
    frameworks: tuple[str, ...] = ()
    rationale: str = ""
    remediation: dict[str, tuple[str, ...]] = field(default_factory=dict, hash=False)
    vendors: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    probe: str | None = None

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES:
            raise RuleError(f"{self.id}: unknown severity {self.severity!r}")
        parse(self.assertion)

    @property
    def verifiable(self) -> bool:
        return self.probe is not None and self.severity in ("critical", "high")


SHIPPED = [
    Rule(f"CIS-NET-{n}", severity, assertion, WORDS[n][0], ("CIS-v8", *frameworks.split()), WORDS[n][1], {k: tuple(v) for k, v in COMMANDS[n].items()}, probe=probe)
    for n, severity, assertion, probe, frameworks in RULES
]


def from_documents(documents: Iterable[tuple[str, object]]) -> list[Rule]:
    """Rules of parsed YAML documents (name, list of mappings); names that begin with ``_`` are skipped."""
    out: dict[str, Rule] = {}
    for name, document in documents:
        parts = name.split("/")
        if parts[-1].startswith("_") or "_template" in parts:
            continue
        for raw in document or []:  # type: ignore[attr-defined]
            lost = [k for k in REQUIRED if k not in raw]
            if lost:
                raise RuleError(f"{name}: a rule lacks {', '.join(lost)}")
            scope = raw.get("applies_to") or {}
            rule = Rule(
                str(raw["id"]), str(raw["severity"]).lower(), str(raw["assert"]), str(raw["title"]), tuple(map(str, raw["frameworks"])), str(raw["rationale"]).strip(),
                {k: tuple(map(str, v or [])) for k, v in (raw["remediation"] or {}).items()}, tuple(scope.get("vendor", ())), tuple(scope.get("role", ())), (raw.get("verify") or {}).get("probe"),
            )
            if rule.id in out:
                raise RuleError(f"{name}: {rule.id} is there twice")
            out[rule.id] = rule
    if not out:
        raise RuleError("no rules")
    return [out[k] for k in sorted(out)]


def to_documents(rules: list[Rule]) -> list[dict]:
    """Rules as a plain document, which ``from_documents`` reads again."""
    out = []
    for r in rules:
        one = {"id": r.id, "title": r.title, "frameworks": list(r.frameworks), "severity": r.severity, "assert": r.assertion, "rationale": r.rationale, "remediation": {k: list(v) for k, v in r.remediation.items()}}
        scope = {k: list(v) for k, v in (("vendor", r.vendors), ("role", r.roles)) if v}
        out.append(one | ({"applies_to": scope} if scope else {}) | ({"verify": {"probe": r.probe}} if r.probe else {}))
    return out


def for_framework(rules: list[Rule], prefix: str) -> list[Rule]:
    """Rules with an identifier that begins so, whatever the case."""
    return [r for r in rules if any(f.lower().startswith(prefix.lower()) for f in r.frameworks)]


def families(rules: list[Rule]) -> list[str]:
    heads = {f.split(":")[0] for r in rules for f in r.frameworks}
    return sorted({"DISA-STIG" if h.startswith("STIG") else h for h in heads})


def digest(rules: list[Rule]) -> str:
    body = sorted(({"assert": r.assertion, "id": r.id, "severity": r.severity} for r in rules), key=lambda x: x["id"])
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:16]


def of_framework(table: DataFrame, prefix: str) -> DataFrame:
    """Rules of a table (frameworks) with an identifier that begins so, whatever the case."""
    return table.where(F.exists("frameworks", lambda f: F.lower(f).startswith(prefix.lower())))


def families_of(table: DataFrame, by: str) -> DataFrame:
    """The column ``by`` and family: the families of the rules (frameworks) of each rule set."""
    head = F.split_part("f", F.lit(":"), F.lit(1))
    return table.select(by, F.explode("frameworks").alias("f")).select(by, F.when(head.startswith("STIG"), "DISA-STIG").otherwise(head).alias("family")).distinct()


_SAID = StructType([StructField(n, StringType()) for n in ("assert", "id", "severity")])


def digests(table: DataFrame, by: str) -> DataFrame:
    """The column ``by``, n, verifiable and digest (as ``digest``) of rule sets (rule_id, severity, assertion, probe).

    A hash takes a rule set in order, so each is one task's array of short texts; sets are spread over tasks."""
    one = F.struct(F.col("assertion").alias("assert"), F.col("rule_id").alias("id"), "severity")
    texts = table.withColumn("t", F.struct("rule_id", canonical_json(one, _SAID).alias("json")))
    body = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["json"]), ","), F.lit("]"))
    sure = F.col("probe").isNotNull() & F.col("severity").isin("critical", "high")
    return texts.groupBy(by).agg(F.count("*").alias("n"), F.count_if(sure).alias("verifiable"), F.left(F.sha2(body, 256), F.lit(16)).alias("digest"))


def severity_rank(column: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(column == kv[1], kv[0]), enumerate(SEVERITIES), F.when(F.lit(False), 0)).otherwise(9)


FINDING = {
    "rule_id": "string", "title": "string", "severity": "string", "verdict": "string", "state": "string", "touched": "array<string>", "unresolved": "array<string>", "target": "string", "commands": "array<string>",
}


def findings(devices: DataFrame, rules: list[Rule], role: str | None = None, vendor: str = "device.vendor", fields: tuple[str, ...] = ()) -> DataFrame:
    """One row per device and rule: a single projection of compiled columns, unpivoted without shuffle.

    ``devices`` holds a document per row; columns besides the compiled ones' are kept as they are named
    ``device_id``.  Verdicts are pass, fail, unknown and not_applicable.  ``fields`` names what is wanted of
    a finding; the rest is then not worked out.
    """
    made = _made(devices.schema, Same(tuple(rules)), role, vendor, tuple(fields))
    return devices.select("device_id", F.explode(made).alias("f")).select("device_id", "f.*")


class Same(tuple):
    """Rules that are the same only if they are the same objects: their commands take no part in a hash."""

    def __hash__(self) -> int:
        return hash(tuple(map(id, self)))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Same) and len(self) == len(other) and all(a is b for a, b in zip(self, other, strict=True))


@per_session
def _made(schema: StructType, rules: Same, role: str | None, vendor: str, fields: tuple[str, ...]) -> Column:
    """The findings of a document, as an array."""
    compiler = Compiler(schema)
    made = []
    who = F.coalesce(F.col(vendor), F.lit("unknown")) if vendor else F.lit("unknown")
    for rule in rules:
        c = compiler.compile(rule.assertion)
        verdict = c.verdict()
        if rule.vendors:
            verdict = F.when(~who.isin(*rule.vendors), "not_applicable").otherwise(verdict)
        if rule.roles and role is not None and role not in rule.roles:
            verdict = F.lit("not_applicable")
        unresolved = F.when(verdict == "unknown", c.missing).when(verdict == "not_applicable", F.array()).otherwise(c.absent)
        target: Column = F.lit(None).cast("string")
        for name, keys in reversed(TARGETS.items()):
            key = next((k for k in keys if rule.remediation.get(k)), None)
            if key:
                target = F.when(who == name, key).otherwise(target)
        commands: Column = F.array().cast("array<string>")
        for key, lines in rule.remediation.items():
            commands = F.when(target == key, F.array(*map(F.lit, lines))).otherwise(commands)
        failed = verdict == "fail"
        whole = {
            "rule_id": F.lit(rule.id), "title": F.lit(rule.title), "severity": F.lit(rule.severity), "verdict": verdict, "state": F.when(verdict == "unknown", "unknown").otherwise("asserted"),
            "touched": c.touched, "unresolved": unresolved, "target": F.when(failed, target), "commands": F.when(failed, commands).otherwise(F.array()),
        }
        made.append(F.struct(*(whole[k].cast(t).alias(k) for k, t in FINDING.items() if not fields or k in fields)))
    return F.array(*made)


def summary(found: DataFrame) -> DataFrame:
    """Counts per verdict, failures per severity, and the score, for each device."""
    decided = F.count_if(F.col("verdict").isin("pass", "fail", "unknown"))
    passed = F.count_if(F.col("verdict") == "pass")
    return found.groupBy("device_id").agg(
        *(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("pass", "fail", "unknown", "not_applicable")),
        *(F.count_if((F.col("verdict") == "fail") & (F.col("severity") == s)).alias(f"fail_{s}") for s in SEVERITIES),
        F.when(decided == 0, 0).otherwise(F.bround(100.0 * passed / F.greatest(decided, F.lit(1)))).cast("int").alias("score"),
    )


def placed(found: DataFrame) -> DataFrame:
    """Findings with their place in a device's report: worst first, unknown last within a severity."""
    order = W.partitionBy("device_id").orderBy(severity_rank(F.col("severity")), F.col("verdict") == "unknown", "rule_id")
    return found.where(F.col("verdict").isin("fail", "unknown")).withColumn("place", F.row_number().over(order))


def ordered(found: DataFrame) -> DataFrame:
    """Findings as a report lists them."""
    return placed(found).orderBy("device_id", "place").drop("place")


def project(rules: list[Rule], spark) -> DataFrame:  # noqa: ANN001
    """The rules' metadata as a table."""
    rows = [(r.id, r.title, r.severity, list(r.frameworks), r.assertion, r.verifiable) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, title string, severity string, frameworks array<string>, assertion string, verifiable boolean")


