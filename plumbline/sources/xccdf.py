"""Benchmarks in XCCDF, and the rules that bindings make of their controls."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.rules import Rule, RuleError

#: Fixed: how a control's severity is called here.
SEVERITY = {"high": "critical", "medium": "medium", "low": "low"}
COLUMNS = "vuln_id string, rule_id string, stig_id string, title string, severity string, ccis array<string>, discussion string, fix string"


@dataclass(frozen=True)
class Binding:
    assertion: str
    stig_id: str | None = None
    vuln_id: str | None = None
    remediation_from: str | None = None
    remediation: dict[str, tuple[str, ...]] = field(default_factory=dict, hash=False)
    frameworks: tuple[str, ...] = ()
    vendors: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    severity: str = ""

    @staticmethod
    def of(raw: object) -> Binding:
        if not isinstance(raw, dict) or not raw.get("assert") or not (raw.get("stig_id") or raw.get("vuln_id")):
            raise RuleError("a binding needs an assertion and a stig_id or vuln_id")
        scope = raw.get("applies_to") or {}
        fixes = {str(k): tuple(map(str, v or ())) for k, v in (raw.get("remediation") or {}).items()}
        return Binding(
            str(raw["assert"]), raw.get("stig_id"), raw.get("vuln_id"), raw.get("remediation_from"), fixes, tuple(map(str, raw.get("frameworks") or ())),
            tuple(scope.get("vendor", ())), tuple(scope.get("role", ())), str(raw.get("severity") or "").lower(),
        )


def bindings(document: object) -> list[Binding]:
    """The bindings of a parsed file: a mapping with the list ``bindings``."""
    if not isinstance(document, dict) or not isinstance(document.get("bindings"), list):
        raise RuleError("a file of bindings is a mapping with a list of bindings")
    return [Binding.of(raw) for raw in document["bindings"]]


def text_of(path: str) -> str:
    """The benchmark's text; of a zip archive the first member that ends in xccdf.xml."""
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as archive:
            name = next((n for n in sorted(archive.namelist()) if n.lower().endswith("xccdf.xml")), None)
            if name is None:
                raise RuleError("the archive holds no benchmark")
            return archive.read(name).decode("utf-8-sig")
    with open(path, encoding="utf-8-sig") as file:
        return file.read()


def _strip(tag: str) -> str:
    return tag.rpartition("}")[2]


def controls(text: str) -> list[tuple]:
    """Rows of ``COLUMNS``; documents with a document type are refused, namespaces don't matter."""
    if re.search(r"<!\s*(doctype|entity)", text, re.I):
        raise RuleError("a document type is refused")
    try:
        root = ET.fromstring(text.encode())
    except ET.ParseError as e:
        raise RuleError(f"not well-formed: {e}") from e
    out = []
    for group in (g for g in root.iter() if _strip(g.tag) == "Group"):
        for rule in (r for r in group if _strip(r.tag) == "Rule"):
            child = lambda name, of=rule: next(("".join(c.itertext()).strip() for c in of if _strip(c.tag) == name), "")
            idents = [(c.get("system", ""), (c.text or "").strip()) for c in rule if _strip(c.tag) == "ident"]
            about = re.sub(r"(?s)^.*<VulnDiscussion>(.*?)</VulnDiscussion>.*$", r"\1", child("description"))
            out.append((group.get("id", ""), rule.get("id", ""), child("version"), child("title"), SEVERITY.get(rule.get("severity", "").lower(), "info"), [v for s, v in idents if "cci" in s.lower() or v.startswith("CCI-")], about.strip(), child("fixtext")))
    if not out:
        raise RuleError("the benchmark has no controls")
    return out


def benchmark(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(controls(text), COLUMNS)


def clean_id(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "-", text).strip("-")[:64]


def frameworks(vuln: str, stig: str, ccis: list[str]) -> tuple[str, ...]:
    """Fixed: how a control's own names are written among a rule's frameworks."""
    return (f"STIG:{stig or vuln}", f"STIG-VULN:{vuln}", *(f"CCI:{x}" for x in ccis))


def bind(rows: list[tuple], bindings: list[Binding], known: list[Rule]) -> tuple[list[Rule], list[tuple]]:
    """Rules of bound controls, and the controls that stay manual; the first binding of a control counts.

    Commands are those of the rule that the binding names, else the binding's own, else the benchmark's text as a
    manual step."""
    by_id = {r.id: r for r in known}
    by_name: dict[tuple[str, str], tuple[int, Binding]] = {}
    for place, b in enumerate(bindings):
        for name in (("stig", b.stig_id), ("vuln", b.vuln_id)):
            if name[1]:
                by_name.setdefault((name[0], name[1].lower()), (place, b))
    made, manual = [], []
    for row in rows:
        vuln, _, stig, title, severity, ccis, about, fix = row
        fit = [by_name[k] for k in (("stig", stig.lower()), ("vuln", vuln.lower())) if k in by_name]
        if not fit:
            manual.append(row)
            continue
        b = min(fit, key=lambda x: x[0])[1]
        if b.remediation_from and b.remediation_from not in by_id:
            raise RuleError(f"{stig or vuln}: remediation of unknown rule {b.remediation_from}")
        remediation = by_id[b.remediation_from].remediation if b.remediation_from else b.remediation
        remediation = remediation or {"manual": (fix or "See the benchmark fix text.",)}
        made.append(Rule(clean_id(stig or vuln), b.severity or severity, b.assertion, title, frameworks(vuln, stig, ccis) + b.frameworks, about or title, dict(remediation), b.vendors, b.roles))
    return made, manual


def catalogue(rows: list[tuple], manual: list[tuple]) -> list[dict]:
    """Every control with what becomes of it: bound to a rule, or left to a person."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    left = {(r[0], r[1]) for r in manual}
    out = []
    for row in rows:
        free = (row[0], row[1]) in left
        out.append(dict(zip(names, row, strict=True)) | {"bound": not free, "status": "manual review" if free else "evaluated"} | ({} if free else {"rule": clean_id(row[2] or row[0])}))
    return out


def counts(df: DataFrame, bound: list[str]) -> DataFrame:
    """Controls per severity, and how many a machine can check."""
    return df.groupBy("severity").agg(F.count("*").alias("controls"), F.count_if(F.col("stig_id").isin(*bound)).alias("checked"))
