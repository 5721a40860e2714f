"""Reports: remediation phases, plans, projected scores, rendered text and exit codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.rules import severity_rank

PHASES = {0: "Establish the safe path", 1: "Harden", 2: "Disable weak services", 3: "Restrict management access"}
#: Fixed: what in the commands places a fix in a phase, tried in this order; phase 1 is the rest.
MARKERS = [
    (3, ["access-class", "access-list", "trusthost", "ip access-group", "firewall filter", "connection-limit", "permitted-ip"]),
    (2, ["no ip telnet", "transport input ssh", "admin-telnet disable", "telnet disabled=yes", "delete service telnet", "delete system services telnet", "no ip http server", "www disabled=yes", "no snmp-server community", "snmp community remove", "no username", "disable-telnet yes", "disable-http yes", "access-setting version v2c"]),
    (0, ["ip ssh", "set service ssh", "protocol-version", "aaa new-model", "aaa authentication", "tacacs", "radius", "logging host", "logging trap", "syslogd", "ntp ", "snmp-server user", "snmp-server group", "security-level", "disable-ssh no", "disable-https no", "access-setting version v3", "ntp-servers", "log-settings syslog", "server-profile tacplus"]),
]


def phase(text: Column, markers: list[tuple[int, list[str]]] = MARKERS) -> Column:
    low = F.lower(text)
    out: Column = F.lit(1)
    for number, words in reversed(markers):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, number).otherwise(out)
    return out


def plan(found: DataFrame) -> DataFrame:
    """Failed findings with commands, in the order in which they are safe to apply: device_id, place, phase,
    phase_name, rule_id, severity, target, commands."""
    from pyspark.sql import Window as W

    steps = found.where("verdict = 'fail' and size(commands) > 0").withColumn("phase", phase(F.array_join("commands", "\n")))
    name = F.lit(None).cast("string")
    for k, v in PHASES.items():
        name = F.when(F.col("phase") == k, v).otherwise(name)
    order = W.partitionBy("device_id").orderBy("phase", severity_rank(F.col("severity")), "rule_id")
    return steps.select("device_id", F.row_number().over(order).alias("place"), "phase", name.alias("phase_name"), "rule_id", "severity", "target", "commands")


def by_phase(steps: DataFrame) -> DataFrame:
    """device_id, phase, phase_name and the rules of each phase of a plan, in their order."""
    return steps.groupBy("device_id", "phase", "phase_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "rule_id"))), lambda s: s["rule_id"]).alias("rules"))


def by_state(found: DataFrame) -> DataFrame:
    """How many findings are demonstrated, asserted or unknown."""
    return found.groupBy("state").agg(F.count("*").alias("n"))


def unsupported(found: DataFrame) -> DataFrame:
    return found.where("verdict = 'fail' and size(commands) = 0").select("device_id", "rule_id")


def projected(found: DataFrame) -> DataFrame:
    """Score now and after the printed commands; what is unknown is never taken for fixed."""
    passed = F.count_if(F.col("verdict") == "pass")
    fixed = F.count_if((F.col("verdict") == "fail") & (F.size("commands") > 0))
    decided = F.count_if(F.col("verdict").isin("pass", "fail", "unknown"))
    score = lambda n: F.when(decided == 0, 0).otherwise(F.bround(100.0 * n / F.greatest(decided, F.lit(1)))).cast("int")
    return found.groupBy("device_id").agg(score(passed).alias("score"), score(passed + fixed).alias("projected_score"))


def exit_code(found: DataFrame) -> DataFrame:
    """One row: 2 if nothing was audited, 1 if a high or critical control fails, else 0."""
    bad = F.count_if((F.col("verdict") == "fail") & F.col("severity").isin("critical", "high"))
    return found.agg(F.when(F.count("*") == 0, 2).when(bad > 0, 1).otherwise(0).alias("exit_code"))


def prove_exit_code(proofs: DataFrame, *by: str) -> DataFrame:
    """A row (per ``by``) over (available, demonstrated, closed): 2 without a sandbox, 1 if a proof stays
    open, else 0."""
    return proofs.groupBy(*by).agg(F.when(F.count_if("available") == 0, 2).when(F.count_if(F.col("demonstrated") & ~F.col("closed")) > 0, 1).otherwise(0).alias("exit_code"))


def listing(found: DataFrame, everything: bool = False) -> DataFrame:
    rows = found.where("verdict in ('fail', 'unknown')")
    return rows if everything else rows.where(F.col("severity").isin("critical", "high"))


def report_id(device: Column, at: Column) -> Column:
    slug = F.left(F.upper(F.regexp_replace(device, "[^A-Za-z0-9]+", "")), F.lit(12))
    return F.concat_ws("-", F.lit("AUDIT"), F.date_format(at, "yyyyMMdd"), slug, F.lit("0001"))


def fleet_summary(scores: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row: devices, mean score, and coverage from the counts, not from percentages."""
    s = scores.agg(F.count("*").alias("devices"), F.coalesce(F.bround(F.avg("score")), F.lit(0.0)).cast("int").alias("score"))
    c = coverage.agg(F.sum("parsed_lines").alias("p"), F.sum("total_lines").alias("t"))
    return s.crossJoin(c).select("devices", "score", F.bround(F.coalesce(F.try_divide(100.0 * F.col("p"), F.col("t")), F.lit(0.0)), 1).alias("coverage"))


def audit_documents(found: DataFrame, coverage: DataFrame, cited: DataFrame | None = None, rule_set: str | None = None) -> DataFrame:
    """One JSON-ready row per device: summary, findings in order with their evidence, passed rules, phases of
    the plan, and the digest of the rules."""
    piece = "array<struct<file:string,ir_path:string,line:int,raw:string>>"
    if cited is None:
        found = found.withColumn("evidence", F.array().cast(piece))
    else:
        one = F.struct("n", F.struct("file", "ir_path", F.col("line_no").alias("line"), "raw").alias("e"))
        held = cited.groupBy("device_id", "rule_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["e"]).cast(piece).alias("evidence"))
        found = found.join(held.hint("merge"), ["device_id", "rule_id"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(piece)))
    listed = found.where("verdict in ('fail', 'unknown')").select("device_id", F.struct(severity_rank(F.col("severity")).alias("s"), (F.col("verdict") == "unknown").alias("u"), "rule_id", "title", "severity", "verdict", "state", "unresolved", "target", "commands", "evidence").alias("f"))
    listed = listed.groupBy("device_id").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f.dropFields("s", "u")).alias("findings"))
    passed = found.where("verdict = 'pass'").groupBy("device_id").agg(F.array_sort(F.collect_list("rule_id")).alias("passed"))
    steps = plan(found).groupBy("device_id").agg(F.array_sort(F.collect_list(F.struct("place", "phase", "phase_name", "rule_id", "commands"))).alias("remediation"))
    states = found.groupBy("device_id").agg(*(F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("demonstrated", "asserted", "unknown")))
    rows = projected(found).join(states.hint("merge"), "device_id")
    for part in (coverage, listed, passed, steps):  # one row a device each: no broadcast
        rows = rows.join(part.hint("merge"), "device_id", "left")
    return rows.withColumn("rule_set", F.lit(rule_set).cast("string"))


def markdown(audits: DataFrame) -> DataFrame:
    """device_id and a readable report of seven sections."""
    kind = audits.schema["findings"].dataType
    some = F.coalesce("findings", F.array().cast(kind))
    of = lambda verdict: F.filter(some, lambda f: f["verdict"] == verdict)
    cite = lambda e: F.concat(F.lit("  - `"), e["file"], F.lit(":"), e["line"].cast("string"), F.lit("` "), F.trim(e["raw"]))
    line = lambda f: F.concat_ws("\n", F.concat(F.lit("- **"), f["severity"], F.lit("** "), f["rule_id"], F.lit(" "), f["title"]), F.when(F.size(f["evidence"]) > 0, F.array_join(F.transform(f["evidence"], cite), "\n")))
    open_ = lambda f: F.concat(F.lit("- **"), f["severity"], F.lit("** "), f["rule_id"], F.lit(" "), f["title"], F.lit(": nothing says "), F.array_join(f["unresolved"], ", "))
    step = lambda s: F.concat(F.lit("### "), s["phase_name"], F.lit(" ("), s["rule_id"], F.lit(")\n\n```\n"), F.array_join(s["commands"], "\n"), F.lit("\n```"))
    rest = F.array_join(F.transform("unparsed_sample", lambda u: F.concat(F.lit("    "), u["file"], F.lit(":"), u["line_no"].cast("string"), F.lit(" "), u["raw"])), "\n") if "unparsed_sample" in audits.columns else F.lit("")
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    part = lambda title, text: F.concat(F.lit(f"## {title}\n\n"), F.coalesce(text, F.lit("")))
    body = F.concat_ws(
        "\n\n",
        F.concat(F.lit("# Audit of "), "device_id"),
        part("Summary", F.concat(F.lit("Score "), number("score"), F.lit("%, after the plan "), number("projected_score"), F.lit("%."))),
        part("Coverage", F.concat(number("parsed_lines"), F.lit(" of "), number("total_lines"), F.lit(" lines read."))),
        part("Findings", F.array_join(F.transform(of("fail"), line), "\n")),
        part("Not decided", F.array_join(F.transform(of("unknown"), open_), "\n")),
        part("Passed", F.array_join(F.coalesce("passed", F.array().cast("array<string>")), ", ")),
        part("Plan", F.array_join(F.transform("remediation", step), "\n\n")),
        part("Not read", rest),
    )
    return audits.select("device_id", body.alias("report"))
