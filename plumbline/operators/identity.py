"""Which device a bundle is: weighted signatures, and prioritised patterns for identity values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.reuse import per_session

LEAST = 0.45

#: Fixed: vendor, system, and the patterns that speak for it with their weights.
SIGNATURES = [
    ("cisco", "IOS", [(r"^service timestamps ", 5), (r"^line vty \d+ \d+", 5), (r"^ip ssh version", 3), (r"^spanning-tree mode (rapid-)?pvst", 4), (r"^switchport mode ", 2), (r"^snmp-server community ", 2), (r"^boot-(start|end)-marker", 4), (r"^interface (Gigabit|Fast|Ten)Ethernet", 3)]),
    ("arista", "EOS", [(r"^management (ssh|telnet|api http-commands)", 8), (r"role network-admin", 6), (r"^transceiver qsfp default-mode", 6), (r"EOS-4\.", 6), (r"^interface Ethernet\d", 3), (r"^no aaa root", 5)]),
    ("fortinet", "FortiOS", [(r"^#config-version=", 10), (r"^config system global", 8), (r"^\s*set admintimeout ", 6), (r"^\s*next$", 3), (r'^\s*edit "', 3)]),
    ("juniper", "JUNOS", [(r"^system \{", 8), (r"^\s*host-name \S+;", 6), (r"protocol-version v2;", 5), (r"^\s*unit \d+ \{", 5), (r"^version \d+\.\dR", 6), (r"^interfaces \{", 5)]),
    ("mikrotik", "RouterOS", [(r"^/ip service set ", 9), (r"^/system identity set ", 8), (r"^/interface bridge add ", 6), (r"by RouterOS", 8), (r"^/ip firewall filter add ", 5)]),
    ("paloalto", "PAN-OS", [(r"<config .*urldb=", 10), (r'<devices>\s*<entry name="localhost.localdomain"', 10), (r"<deviceconfig>", 8)]),
]
#: Fixed: patterns of identity values, best first; the last column says whether show output alone counts.
PATTERNS = [
    ("serial", [r"(?i)^\s*System serial number\s*:\s*(\S+)", r"(?i)^\s*Chassis Serial Number\s*:\s*(\S+)", r"(?i)^\s*Serial Number\s*:\s*(\S+)", r"(?i)^[#\s]*serial number\s*=\s*(\S+)", r"(?i)^\s*Processor board ID\s+(\S+)", r"^\s*[Ss]erial[- ]?[Nn]um(?:ber)?\s+(\S+)"], True),
    ("model", [r"(?i)^\s*Model number\s*:\s*(\S+)", r"(?i)^\s*Model\s*:\s*(\S+)", r"(?i)^\s*#\s*model\s*=\s*(\S+)", r"(?i)^cisco (\S+) \(.*processor", r"(?i)^\s*Hardware model\s*:\s*(\S+)"], False),
    ("version", [r"(?i)Cisco IOS Software.*Version (\S+?),", r"(?i)^\s*Software image version\s*:\s*(\S+)", r"(?i)^\s*Version\s*:\s*(\S+)", r"(?i)by RouterOS ([\d.]+)", r"(?i)EOS-(\S+?)\)"], False),
    ("hostname", [r"(?i)^(\S+)[#>]\s*show version", r"(?i)^\s*Hostname\s*:\s*(\S+)"], True),
]
COMMENT_SERIAL = PATTERNS[0][1][3]


def signature_scores(text: Column, signatures: list = SIGNATURES) -> Column:
    """An array of (score, -place, vendor, os), best first, without zero scores: one pass of columns."""
    made = [
        F.struct(sum((F.when(text.rlike("(?m)" + p), w).otherwise(0) for p, w in patterns), F.lit(0)).alias("score"), F.lit(-k).alias("place"), F.lit(vendor).alias("vendor"), F.lit(os).alias("os"))
        for k, (vendor, os, patterns) in enumerate(signatures)
    ]
    return F.reverse(F.array_sort(F.filter(F.array(*made), lambda s: s["score"] > 0)))


@per_session
def _signatures() -> Column:
    return signature_scores(F.col("text"))


def confidence(ranked: Column) -> Column:
    """Strength of the best score times its lead over the second; null without scores."""
    best, second = F.get(ranked, F.lit(0))["score"], F.coalesce(F.get(ranked, F.lit(1))["score"], F.lit(0))
    strength = F.least(F.lit(0.15) + F.lit(0.85) * F.least(best / F.lit(20.0), F.lit(1.0)), F.lit(1.0))
    return F.bround(strength * (F.lit(0.5) + F.lit(0.5) * (best - second) / best), 3)


def main_file(files: DataFrame) -> DataFrame:
    """The longest configuration of each device; without configurations, its first file."""
    n = F.size(F.split("text", "\n"))
    order = W.partitionBy("device_id").orderBy(F.col("role") == "show_output", F.when(F.col("role") == "config", -n), "file")
    return files.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def identify(files: DataFrame, lines: DataFrame) -> DataFrame:
    """device_id, vendor, os, confidence_bp, hostname, version, model, serial."""
    scored = main_file(files).select("device_id", _signatures().alias("ranked"))
    best = F.get("ranked", F.lit(0))
    sure = F.coalesce(confidence(F.col("ranked")), F.lit(0.0))
    named = scored.select(
        "device_id", F.when(sure >= LEAST, best["vendor"]).otherwise("unknown").alias("vendor"), F.when(sure >= LEAST, best["os"]).alias("os"),
        F.bround(sure * 10000).cast("int").alias("confidence_bp"),
    )
    return named.join(identity_values(lines), "device_id", "left")


@per_session
def _identity_hits() -> Column:
    """The identity values that a line shows, as an array of (key, rank, value)."""
    made = []
    for key, patterns, show_only in PATTERNS:
        for k, p in enumerate(patterns):
            allowed = (F.col("role") == "show_output") if show_only else F.lit(True)
            hit = F.regexp_replace(F.regexp_extract("raw", p, 1), "^[\",;]+|[\",;]+$", "")
            made.append(F.when(allowed & (hit != ""), F.struct(F.lit(key).alias("key"), F.lit(k).alias("rank"), hit.alias("value"))))
    last = F.regexp_extract("raw", COMMENT_SERIAL, 1)
    made.append(F.when(last != "", F.struct(F.lit("serial").alias("key"), F.lit(99).alias("rank"), last.alias("value"))))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def identity_values(lines: DataFrame) -> DataFrame:
    """The first match per value: pattern before file before line."""
    found = lines.select("device_id", "file", "line_no", F.explode(_identity_hits()).alias("x")).select("device_id", "file", "line_no", "x.*")
    order = F.struct("rank", "file", "line_no")
    pick = lambda key: F.min_by(F.when(F.col("key") == key, F.col("value")), F.when(F.col("key") == key, order)).alias(key)
    return found.groupBy("device_id").agg(*(pick(k) for k, _, _ in PATTERNS))
