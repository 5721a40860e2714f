"""Queries over rendered configurations: grammars, identity, documents, rules, evidence, reports.

The SQL beside a query never reads a configuration: it says what the rendered lines mean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline import rendered
from plumbline.operators import documents, drift, identity, packs, parsing, report, validation
from plumbline.plans import audit, rules
from plumbline.plans.shipped import COMMANDS
from plumbline.registry import query, table
from plumbline.rendered import FLEET_FACTS, FLEET_LINES, ONE, SHOW, VENDORS, facts_sql, sql_text
from plumbline.sources import bundle

_HELD: dict[tuple[str, str], audit.Audit] = {}


def fleet(spark: SparkSession, sf_dir: str) -> audit.Audit:
    """The audit of the mixed fleet, made once a session and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _HELD:
        _HELD[key] = audit.run(rendered.mixed(spark, sf_dir))
    return _HELD[key]


# -- grammars -------------------------------------------------------------------------------------

#: the line number of an entry's list is a detail of the facts that documents need
_INNER = "acls.entries.acl"


def _parse_query(vendor: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = rendered.files(spark, sf_dir, vendor)
        vendors = files.select("device_id", F.lit(vendor).alias("vendor"))
        facts = parsing.parse(bundle.lines(files), vendors)
        return facts.where(f"path is not null and path <> '{_INNER}'").select("device_id", F.col("line_no").cast("long").alias("line_no"), "path", "value")

    query(f"SELECT 'd' || k AS device_id, line_no, path, value FROM ({facts_sql(vendor, ONE)})", f"parse_{vendor}")(run)


for _vendor in VENDORS:
    _parse_query(_vendor)

_WITH = f"""WITH facts AS (SELECT 'd' || k AS device_id, k, vendor, line_no, path, value FROM ({FLEET_FACTS})),
lines AS (SELECT 'd' || k AS device_id, k, vendor, i, line_no, claimed FROM ({FLEET_LINES})),
devices AS (SELECT 'd' || s_suppkey AS device_id, s_suppkey AS k, s_suppkey // 6 AS q, ['{"', '".join(VENDORS)}'][s_suppkey % 6 + 1] AS vendor, s_nationkey AS nat, s_suppkey % 250 + 1 AS n, s_name AS name FROM supplier)"""
#: every line with its text
_TEXTS = " UNION ALL ".join(
    f"SELECT l.device_id, l.vendor, l.line_no, l.claimed, t.text AS text FROM (SELECT device_id, unnest([{', '.join('{' + chr(39) + 'i' + chr(39) + f': {k}, ' + chr(39) + 'text' + chr(39) + f': {sql_text(x.text)}' + '}' for k, x in enumerate(lines))}]) AS t FROM devices WHERE vendor = '{v}') d JOIN lines l ON l.device_id = d.device_id AND l.i = d.t.i"
    for v, lines in VENDORS.items()
)


@query(f"""{_WITH}, every AS (SELECT device_id, claimed FROM lines UNION ALL SELECT device_id, true FROM devices, range(3) WHERE vendor = 'cisco')
SELECT device_id, count(*) AS total_lines, count(*) FILTER (WHERE claimed) AS parsed_lines, count(*) FILTER (WHERE NOT claimed) AS unparsed_lines, count(*) FILTER (WHERE claimed) AS tier0, 0::BIGINT AS tier1,
round_even(100.0 * count(*) FILTER (WHERE claimed) / count(*), 1)::DOUBLE AS percent FROM every GROUP BY device_id""")
def fleet_coverage(spark, sf_dir):
    return fleet(spark, sf_dir).coverage.select("device_id", "total_lines", "parsed_lines", "unparsed_lines", "tier0", "tier1", "percent")


@query(f"{_WITH}, texts AS ({_TEXTS}) SELECT device_id, 'running' AS file, line_no, text AS raw FROM texts WHERE NOT claimed")
def fleet_residue(spark, sf_dir):
    a = fleet(spark, sf_dir)
    return documents.residue(a.lines, a.facts).select("device_id", "file", F.col("line_no").cast("long").alias("line_no"), "raw")


@query(f"""{_WITH} SELECT device_id, vendor, CASE vendor WHEN 'cisco' THEN 'IOS' WHEN 'arista' THEN 'EOS' WHEN 'juniper' THEN 'JUNOS' WHEN 'fortinet' THEN 'FortiOS' WHEN 'mikrotik' THEN 'RouterOS' ELSE 'PAN-OS' END AS os,
CASE vendor WHEN 'arista' THEN 9640 ELSE 10000 END AS confidence_bp, CASE vendor WHEN 'cisco' THEN '15.2(4)M' WHEN 'mikrotik' THEN '7.14' END AS version,
CASE WHEN vendor = 'cisco' THEN 'ISR' || (4000 + q) END AS model, CASE WHEN vendor = 'cisco' THEN 'FTX' || k END AS serial FROM devices""")
def fleet_identity(spark, sf_dir):
    """Weighted signatures, their confidence, and values by pattern, file and line: 28 against 2 for Arista,
    whose lines one signature of another vendor meets."""
    files = rendered.mixed(spark, sf_dir)
    return identity.identify(files, bundle.lines(files)).select("device_id", "vendor", "os", "confidence_bp", "version", "model", "serial")


@query("SELECT 'd' || s_suppkey AS device_id, CASE WHEN s_suppkey % 3 = 0 THEN 'b' ELSE 'a' END AS file FROM supplier")
def main_configuration(spark, sf_dir):
    """The longest configuration counts, the first by name on a tie, show output never."""
    rows = rendered.devices(spark, sf_dir, False)
    file = lambda name, role, text: F.struct(F.lit(name).alias("file"), F.lit(role).alias("role"), F.expr(text).alias("text"))
    made = F.array(file("b", "config", "repeat('x\\n', 5 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END)"), file("a", "config", "repeat('x\\n', 5)"), file("c", "show_output", "repeat('x\\n', 50)"))
    files = rows.select(F.concat(F.lit("d"), F.col("k").cast("string")).alias("device_id"), F.explode(made).alias("f")).select("device_id", "f.*")
    return identity.main_file(files).select("device_id", "file")


_SHOW_LINES = SHOW.count("\n")


@query(f"SELECT 'd' || s_suppkey AS device_id, CAST({_SHOW_LINES} AS BIGINT) AS claimed FROM supplier WHERE s_suppkey % 6 = 0")
def show_output_claimed(spark, sf_dir):
    """Every line of show output counts as read."""
    a = fleet(spark, sf_dir)
    return a.facts.where("file = 'show-version' and claim").groupBy("device_id").agg(F.countDistinct("line_no").alias("claimed"))


# -- documents and rules --------------------------------------------------------------------------

_SCALARS = {
    "telnet": ("mgmt.telnet_enabled", "BOOLEAN"), "http": ("mgmt.http_enabled", "BOOLEAN"), "https": ("mgmt.https_enabled", "BOOLEAN"), "idle": ("mgmt.idle_timeout_min", "INTEGER"), "banner": ("mgmt.login_banner", "BOOLEAN"), "acl": ("mgmt.mgmt_acl", "VARCHAR"),
    "ssh": ("mgmt.ssh.enabled", "BOOLEAN"), "ssh_version": ("mgmt.ssh.version", "INTEGER"), "attempts": ("mgmt.ssh.max_attempts", "INTEGER"), "aaa": ("aaa.enabled", "BOOLEAN"), "accounting": ("aaa.accounting", "BOOLEAN"), "enable_hash": ("aaa.enable_secret_hash", "VARCHAR"),
    "min_length": ("aaa.password_policy.min_length", "INTEGER"), "complexity": ("aaa.password_policy.complexity", "BOOLEAN"), "snmp": ("snmp.version", "INTEGER"), "log_level": ("logging.level", "VARCHAR"), "ntp_auth": ("ntp.authenticated", "BOOLEAN"),
    "discovery": ("services.discovery_protocols", "BOOLEAN"), "source_routing": ("services.source_routing", "BOOLEAN"),
}
_LISTS = {"aaa_servers": "aaa.servers", "communities": "snmp.communities", "log_servers": "logging.servers", "ntp_servers": "ntp.servers"}
_DOCS = f"""{_WITH}, docs AS (SELECT device_id, any_value(vendor) AS vendor, any_value(k) AS k, max(value) FILTER (WHERE path = 'device.hostname') AS hostname,
{', '.join(f"CAST(arg_max(value, line_no) FILTER (WHERE path = '{p}') AS {t}) AS {c}" for c, (p, t) in _SCALARS.items())},
{', '.join(f"list(value ORDER BY line_no) FILTER (WHERE path = '{p}') AS {c}" for c, p in _LISTS.items())},
count(*) FILTER (WHERE path = 'interfaces.name') AS n_interfaces, count(*) FILTER (WHERE path = 'aaa.local_users.name') AS n_users, count(*) FILTER (WHERE path = 'acls.entries.action') AS n_entries FROM facts GROUP BY device_id)"""


@query(f"{_DOCS} SELECT * EXCLUDE (k, {', '.join(_LISTS)}), {', '.join(f'array_to_string({c}, chr(44)) AS {c}' for c in _LISTS)} FROM docs")
def fleet_documents(spark, sf_dir):
    d = fleet(spark, sf_dir).documents
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    entries = F.coalesce(F.aggregate("acls", F.lit(0), lambda s, a: s + F.size(a["entries"])), F.lit(0)).cast("long")
    return d.select(
        "device_id", F.col("device.vendor").alias("vendor"), F.col("device.hostname").alias("hostname"), *(F.col(p).alias(c) for c, (p, _) in _SCALARS.items()), *(F.array_join(p, ",").alias(c) for c, p in _LISTS.items()),
        n(F.coalesce("interfaces", F.array().cast(d.schema["interfaces"].dataType))).alias("n_interfaces"), n(F.coalesce("aaa.local_users", F.array().cast(d.schema["aaa"].dataType["local_users"].dataType))).alias("n_users"), entries.alias("n_entries"),
    )


_ENTITY = "max(line_no) FILTER (WHERE path IN ('interfaces.name', 'aaa.local_users.name', 'acls.name')) OVER (PARTITION BY device_id, split_part(path, '.', 1) ORDER BY line_no RANGE UNBOUNDED PRECEDING)"


@query(f"""{_WITH}, members AS (SELECT *, {_ENTITY} AS entity FROM facts WHERE path LIKE 'interfaces.%')
SELECT device_id, max(value) FILTER (WHERE path = 'interfaces.name') AS name, max(value) FILTER (WHERE path = 'interfaces.addresses') AS address, max(value) FILTER (WHERE path = 'interfaces.description') AS description, max(value) FILTER (WHERE path = 'interfaces.acl_in') AS acl_in,
max(value) FILTER (WHERE path = 'interfaces.zone') AS zone, CAST(max(value) FILTER (WHERE path = 'interfaces.vlan') AS INTEGER) AS vlan, arg_max(value, line_no) FILTER (WHERE path = 'interfaces.shutdown') = 'true' AS shutdown, max(value) FILTER (WHERE path = 'interfaces.is_mgmt') = 'true' AS is_mgmt
FROM members GROUP BY device_id, entity""")
def fleet_interfaces(spark, sf_dir):
    d = fleet(spark, sf_dir).documents.select("device_id", F.explode("interfaces").alias("i"))
    return d.select("device_id", "i.name", F.get("i.addresses", F.lit(0)).alias("address"), "i.description", "i.acl_in", "i.zone", "i.vlan", "i.shutdown", "i.is_mgmt")


@query(f"""{_WITH}, e AS (SELECT device_id, line_no, path, value FROM facts WHERE path LIKE 'acls.entries.%'),
w AS (SELECT device_id, line_no, {', '.join(f"max(value) FILTER (WHERE path = 'acls.entries.{c}') AS {c}" for c in ('seq', 'action', 'protocol', 'src', 'src_port', 'dst', 'dst_port', 'log'))} FROM e GROUP BY ALL)
SELECT device_id, coalesce(CAST(seq AS INTEGER), CAST(10 * row_number() OVER (PARTITION BY device_id ORDER BY line_no) AS INTEGER)) AS seq, action, protocol, src, src_port, dst, dst_port, log = 'true' AS log FROM w""")
def fleet_access_entries(spark, sf_dir):
    """Entries with their parts; one without a number counts on in tens."""
    d = fleet(spark, sf_dir).documents.select("device_id", F.explode("acls").alias("a")).select("device_id", F.explode("a.entries").alias("e"))
    return d.select("device_id", *(F.col(f"e.{c}") for c in ("seq", "action", "protocol", "src", "src_port", "dst", "dst_port", "log")))


@query(f"""{_WITH} SELECT device_id, CAST(count(*) AS BIGINT) AS n, max(value) FILTER (WHERE path = 'aaa.local_users.name') AS last_name, string_agg(value, ',' ORDER BY line_no) FILTER (WHERE path = 'aaa.local_users.hash') AS hashes FROM facts WHERE path LIKE 'aaa.local_users.%' GROUP BY device_id""")
def fleet_account_facts(spark, sf_dir):
    facts = fleet(spark, sf_dir).facts.where("path like 'aaa.local_users.%'")
    hashes = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("path") == "aaa.local_users.hash") & F.col("value").isNotNull(), F.struct("line_no", "value")))), lambda x: x["value"]), ",")
    return facts.groupBy("device_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("path") == "aaa.local_users.name", F.col("value"))).alias("last_name"), F.nullif(hashes, F.lit("")).alias("hashes"))


_HOLDS = {
    "1.1.1": "NOT telnet", "1.1.2": "ssh AND ssh_version = 2", "1.2.4": "idle <= 10", "1.3.1": "NOT http", "1.4.1": "acl IS NOT NULL", "2.1.1": "snmp = 3", "2.1.2": "NOT list_contains(communities, 'default')",
    "3.1.1": "CASE WHEN log_servers IS NOT NULL OR log_level IS NOT NULL THEN log_servers IS NOT NULL END", "4.1.1": "ntp_auth", "5.1.1": "aaa AND (CASE WHEN aaa_servers IS NOT NULL THEN true END)",
    "5.2.1": "CASE vendor WHEN 'cisco' THEN (k // 6) % 4 <> 0 WHEN 'arista' THEN true WHEN 'juniper' THEN true END", "5.3.1": "NULL::BOOLEAN", "6.1.1": "vendor IN ('fortinet', 'paloalto')",
}
_SEVERITY = {r.id[8:]: r.severity for r in rules.SHIPPED}
_VERDICTS = f"""{_DOCS}, verdicts AS (SELECT device_id, vendor, v.r AS rule_id, v.s AS severity, CASE WHEN v.h IS NULL THEN 'unknown' WHEN v.h THEN 'pass' ELSE 'fail' END AS verdict FROM
(SELECT device_id, vendor, unnest([{', '.join(f"{{'r': 'CIS-NET-{r}', 's': '{_SEVERITY[r]}', 'h': {h}}}" for r, h in _HOLDS.items())}]) AS v FROM docs))"""


@query(f"{_VERDICTS} SELECT device_id, rule_id, severity, verdict, CASE WHEN verdict = 'unknown' THEN 'unknown' ELSE 'asserted' END AS state FROM verdicts")
def fleet_verdicts(spark, sf_dir):
    """The shipped rules over all documents."""
    return fleet(spark, sf_dir).findings.select("device_id", "rule_id", "severity", "verdict", "state")


_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


@query(f"{_VERDICTS} SELECT device_id, rule_id, CAST(row_number() OVER (PARTITION BY device_id ORDER BY {_RANK}, verdict = 'unknown', rule_id) AS INTEGER) AS place FROM verdicts WHERE verdict IN ('fail', 'unknown')")
def fleet_findings_order(spark, sf_dir):
    return rules.placed(fleet(spark, sf_dir).findings).select("device_id", "rule_id", "place")


@query(f"""{_VERDICTS} SELECT device_id, {', '.join(f"count(*) FILTER (WHERE verdict = '{v}') AS n_{v}" for v in ('pass', 'fail', 'unknown', 'not_applicable'))}, {', '.join(f"count(*) FILTER (WHERE verdict = 'fail' AND severity = '{s}') AS fail_{s}" for s in rules.SEVERITIES)},
CAST(round_even(100.0::DOUBLE * count(*) FILTER (WHERE verdict = 'pass') / count(*), 0) AS INTEGER) AS score FROM verdicts GROUP BY device_id""")
def fleet_summary(spark, sf_dir):
    return fleet(spark, sf_dir).summary()


@query(f"{_VERDICTS} SELECT device_id, rule_id, verdict FROM verdicts WHERE rule_id IN ('CIS-NET-1.1.1', 'CIS-NET-2.1.1') UNION ALL SELECT device_id, 'ONLY', CASE WHEN vendor IN ('cisco', 'arista') THEN CASE WHEN vendor = 'cisco' THEN 'pass' ELSE 'unknown' END ELSE 'not_applicable' END FROM docs")
def rules_in_scope(spark, sf_dir):
    """A rule of some vendors is not applicable to the others; a role counts only if one is given."""
    own = rules.Rule("ONLY", "low", "mgmt.login_banner == true", vendors=("cisco", "arista"), roles=("core",))
    chosen = [r for r in rules.SHIPPED if r.id in ("CIS-NET-1.1.1", "CIS-NET-2.1.1")]
    return rules.findings(fleet(spark, sf_dir).documents, [*chosen, own]).select("device_id", "rule_id", "verdict")


#: Rule sets of fifty parts each: id, severity, assertion, probe, frameworks.
_RULE_ROWS = """(SELECT 's' || (p_partkey // 50) AS rule_set, 'R-' || p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, 'device.model == "' || p_name || '"' AS assertion, p_partkey % 3 = 0 AS probed,
['CIS-v8', 'NIST-SP800-53:' || CASE WHEN p_partkey % 5 = 0 THEN 'AC' ELSE 'SC' END || '-' || (p_partkey % 9), CASE WHEN p_partkey % 50 < 10 AND p_partkey // 50 % 2 = 0 THEN 'STIG-VULN:V-' || p_partkey ELSE 'OWN:1' END] AS frameworks FROM part)"""


def _rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('s', p_partkey div 50) AS rule_set", "concat('R-', p_partkey) AS rule_id", "element_at(array('critical', 'high', 'medium', 'low'), int(p_partkey % 4 + 1)) AS severity", "concat('device.model == \"', p_name, '\"') AS assertion", "IF(p_partkey % 3 = 0, 'ping', NULL) AS probe",
        "array('CIS-v8', concat('NIST-SP800-53:', IF(p_partkey % 5 = 0, 'AC', 'SC'), '-', p_partkey % 9), IF(p_partkey % 50 < 10 AND p_partkey div 50 % 2 = 0, concat('STIG-VULN:V-', p_partkey), 'OWN:1')) AS frameworks",
    )


@query(f"SELECT rule_set, id AS rule_id, unnest(frameworks) AS framework FROM {_RULE_ROWS} WHERE frameworks[2] LIKE 'NIST-SP800-53:AC%'")
def rules_of_framework(spark, sf_dir):
    """Rules with an identifier that begins so, whatever the case."""
    return rules.of_framework(_rule_rows(spark, sf_dir), "nist-sp800-53:ac").select("rule_set", "rule_id", F.explode("frameworks").alias("framework"))


@query(f"SELECT DISTINCT rule_set, CASE WHEN f LIKE 'STIG%' THEN 'DISA-STIG' ELSE split_part(f, ':', 1) END AS family FROM (SELECT rule_set, unnest(frameworks) AS f FROM {_RULE_ROWS})")
def rule_families(spark, sf_dir):
    return rules.families_of(_rule_rows(spark, sf_dir), "rule_set")


@query(f"""SELECT rule_set, left(sha256('[' || string_agg('{{"assert":"' || replace(assertion, '"', '\\"') || '","id":"' || id || '","severity":"' || severity || '"}}', ',' ORDER BY id) || ']'), 16) AS digest, count(*) FILTER (WHERE probed AND severity IN ('critical', 'high')) AS verifiable FROM {_RULE_ROWS} GROUP BY rule_set""")
def rule_set_digest(spark, sf_dir):
    return rules.digests(_rule_rows(spark, sf_dir), "rule_set").select("rule_set", "digest", "verifiable")


# -- evidence and remediation ---------------------------------------------------------------------

_CITED = {"CIS-NET-1.1.1": "mgmt.telnet_enabled", "CIS-NET-1.2.4": "mgmt.idle_timeout_min", "CIS-NET-1.3.1": "mgmt.http_enabled", "CIS-NET-2.1.1": "snmp.version", "CIS-NET-2.1.2": "snmp.communities", "CIS-NET-4.1.1": "ntp.authenticated"}


@query(f"""{_WITH}, texts AS ({_TEXTS}), sizes AS (SELECT device_id, max(line_no) AS last FROM lines GROUP BY device_id),
cited AS (SELECT device_id, path, CASE WHEN path = 'snmp.communities' THEN min(line_no) ELSE max(line_no) END AS line_no FROM facts GROUP BY device_id, path)
SELECT c.device_id, r.rule_id, c.path AS ir_path, c.line_no, least(c.line_no + 3, last) - greatest(c.line_no - 3, 1) + 1 AS n_lines,
CASE WHEN c.path LIKE 'snmp.%' AND t.text NOT LIKE 'snmp-server group%' THEN replace(t.text, CASE WHEN d.q % 2 = 0 THEN 'public' ELSE 'hush' || d.k END, '<redacted>') ELSE t.text END AS raw
FROM cited c JOIN (VALUES {', '.join(f"('{r}', '{p}')" for r, p in _CITED.items())}) r(rule_id, path) ON r.path = c.path JOIN texts t ON t.device_id = c.device_id AND t.line_no = c.line_no JOIN devices d ON d.device_id = c.device_id JOIN sizes s ON s.device_id = c.device_id""")
def fleet_evidence(spark, sf_dir):
    """The line that a finding cites, without secrets, and the lines around it."""
    a = fleet(spark, sf_dir)
    found = a.findings.where(F.col("rule_id").isin(*_CITED))
    e = documents.evidence(found, a.facts, a.lines, a.salt)
    return e.select("device_id", "rule_id", "ir_path", F.col("line_no").cast("long").alias("line_no"), F.size("excerpt").cast("long").alias("n_lines"), "raw")


_TARGETS_SQL = ", ".join(f"('{v}', {k}, '{t}')" for v, ts in rules.TARGETS.items() for k, t in enumerate(ts))
_COMMANDS_SQL = ", ".join("('CIS-NET-%s', '%s', '%s')" % (r, t, "\n".join(c).replace("'", "''")) for r, targets in COMMANDS.items() for t, c in targets.items())
_FIXES = f"""{_VERDICTS}, targets(vendor, place, target) AS (VALUES {_TARGETS_SQL}), commands(rule_id, target, commands) AS (VALUES {_COMMANDS_SQL}),
fixes AS (SELECT v.device_id, v.rule_id, v.severity, arg_min(t.target, t.place) FILTER (WHERE c.commands IS NOT NULL) AS target, arg_min(c.commands, t.place) FILTER (WHERE c.commands IS NOT NULL) AS commands
FROM verdicts v LEFT JOIN targets t USING (vendor) LEFT JOIN commands c ON c.rule_id = v.rule_id AND c.target = t.target WHERE verdict = 'fail' GROUP BY ALL)"""
_PHASE = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(commands), {chr(39)}{w}{chr(39)})' for w in words)} THEN {n}" for n, words in report.MARKERS) + " ELSE 1 END"


@query(f"{_FIXES} SELECT device_id, rule_id, target, commands FROM fixes")
def fleet_remediation(spark, sf_dir):
    """Commands of the first target of the vendor that a rule has some for; failures only."""
    found = fleet(spark, sf_dir).findings.where("verdict = 'fail'")
    return found.select("device_id", "rule_id", "target", F.nullif(F.array_join("commands", "\n"), F.lit("")).alias("commands"))


@query(f"""{_FIXES}, steps AS (SELECT *, {_PHASE} AS phase FROM fixes WHERE commands IS NOT NULL)
SELECT device_id, rule_id, phase, CAST(row_number() OVER (PARTITION BY device_id ORDER BY phase, {_RANK}, rule_id) AS INTEGER) AS place, ['{"', '".join(report.PHASES.values())}'][phase + 1] AS phase_name FROM steps""")
def fleet_plan(spark, sf_dir):
    """Steps in the order in which they are safe to apply."""
    return report.plan(fleet(spark, sf_dir).findings).select("device_id", "rule_id", "phase", "place", "phase_name")


@query(f"{_FIXES}, steps AS (SELECT *, {_PHASE} AS phase FROM fixes WHERE commands IS NOT NULL) SELECT device_id, phase, count(*) AS steps FROM steps GROUP BY ALL")
def fleet_plan_phases(spark, sf_dir):
    return report.by_phase(report.plan(fleet(spark, sf_dir).findings)).select("device_id", "phase", F.size("rules").cast("long").alias("steps"))


@query(f"{_FIXES} SELECT device_id, rule_id FROM fixes WHERE commands IS NULL")
def fleet_unsupported(spark, sf_dir):
    return report.unsupported(fleet(spark, sf_dir).findings)


@query(f"""{_FIXES}, fixed AS (SELECT device_id, count(*) AS n FROM fixes WHERE commands IS NOT NULL GROUP BY device_id)
SELECT device_id, CAST(round_even(100.0::DOUBLE * count(*) FILTER (WHERE verdict = 'pass') / count(*), 0) AS INTEGER) AS score,
CAST(round_even(100.0::DOUBLE * (count(*) FILTER (WHERE verdict = 'pass') + coalesce(any_value(n), 0)) / count(*), 0) AS INTEGER) AS projected_score FROM verdicts LEFT JOIN fixed USING (device_id) GROUP BY device_id""")
def fleet_projected_score(spark, sf_dir):
    return report.projected(fleet(spark, sf_dir).findings)


@query(f"{_VERDICTS} SELECT CASE WHEN verdict = 'unknown' THEN 'unknown' ELSE 'asserted' END AS state, count(*) AS n FROM verdicts GROUP BY 1")
def findings_by_state(spark, sf_dir):
    return report.by_state(fleet(spark, sf_dir).findings)


@query(f"""{_VERDICTS}, scores AS (SELECT device_id, round_even(100.0::DOUBLE * count(*) FILTER (WHERE verdict = 'pass') / count(*), 0) AS score FROM verdicts GROUP BY device_id),
every AS (SELECT claimed FROM lines UNION ALL SELECT true FROM devices, range(3) WHERE vendor = 'cisco')
SELECT (SELECT count(*) FROM scores) AS devices, (SELECT CAST(round_even(avg(score), 0) AS INTEGER) FROM scores) AS score, (SELECT round_even(100.0 * count(*) FILTER (WHERE claimed) / count(*), 1)::DOUBLE FROM every) AS coverage""")
def fleet_score(spark, sf_dir):
    a = fleet(spark, sf_dir)
    return report.fleet_summary(a.summary(), a.coverage)


@query(f"{_VERDICTS} SELECT CASE WHEN count(*) = 0 THEN 2 WHEN count(*) FILTER (WHERE verdict = 'fail' AND severity IN ('critical', 'high')) > 0 THEN 1 ELSE 0 END AS exit_code FROM verdicts")
def audit_exit_code(spark, sf_dir):
    return report.exit_code(fleet(spark, sf_dir).findings)


@query(f"{_VERDICTS} SELECT device_id, rule_id FROM verdicts WHERE verdict IN ('fail', 'unknown') AND severity IN ('critical', 'high')")
def terminal_listing(spark, sf_dir):
    return report.listing(fleet(spark, sf_dir).findings).select("device_id", "rule_id")


@query("SELECT s_suppkey, 'AUDIT-20260102-' || left(upper(regexp_replace(s_name || '-core', '[^A-Za-z0-9]+', '', 'g')), 12) || '-0001' AS report_id FROM supplier")
def report_identifier(spark, sf_dir):
    rows = rendered.devices(spark, sf_dir, False)
    return rows.select(F.col("k").alias("s_suppkey"), report.report_id(F.concat("name", F.lit("-core")), F.lit("2026-01-02 03:04:05").cast("timestamp")).alias("report_id"))


@query("SELECT l_returnflag, CASE WHEN count(*) FILTER (WHERE l_linenumber > 2) = 0 THEN 2 WHEN count(*) FILTER (WHERE l_quantity > 49 AND l_discount < 0.05) > 0 THEN 1 ELSE 0 END AS exit_code FROM lineitem GROUP BY l_returnflag")
def prove_exit_codes(spark, sf_dir):
    """2 without a sandbox, 1 if a demonstrated finding stays open, else 0; one row a group."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    proofs = items.select("l_returnflag", (F.col("l_linenumber") > 2).alias("available"), (F.col("l_quantity") > 49).alias("demonstrated"), (F.col("l_discount") >= 0.05).alias("closed"))
    return report.prove_exit_code(proofs, "l_returnflag")


@query(f"""{_FIXES}, listed AS (SELECT device_id, string_agg(rule_id, ',' ORDER BY {_RANK}, verdict = 'unknown', rule_id) AS findings FROM verdicts WHERE verdict IN ('fail', 'unknown') GROUP BY device_id),
held AS (SELECT device_id, string_agg(rule_id, ',' ORDER BY rule_id) AS passed FROM verdicts WHERE verdict = 'pass' GROUP BY device_id)
SELECT device_id, findings, passed FROM listed FULL JOIN held USING (device_id)""")
def audit_document(spark, sf_dir):
    """The findings of a device's document in their order, and the rules that hold."""
    rows = fleet(spark, sf_dir).reports()
    return rows.select("device_id", F.array_join(F.transform("findings", lambda f: f["rule_id"]), ",").alias("findings"), F.array_join("passed", ",").alias("passed"))


@query(f"""{_VERDICTS} SELECT device_id, '# Audit of ' || device_id AS title, count(*) FILTER (WHERE verdict IN ('fail', 'unknown')) AS listed, CAST(7 AS BIGINT) AS sections FROM verdicts GROUP BY device_id""")
def markdown_report(spark, sf_dir):
    """A report's title, how many findings it lists, and how many sections it has."""
    text = F.col("report")
    rows = report.markdown(fleet(spark, sf_dir).reports())
    return rows.select("device_id", F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"), F.regexp_count(text, F.lit(r"(?m)^- \*\*")).cast("long").alias("listed"), F.regexp_count(text, F.lit("(?m)^## ")).cast("long").alias("sections"))


# -- learned packs --------------------------------------------------------------------------------

_PACK = packs.Pack("held", "unknown", None, (
    packs.Mapping("mgmt.idle_timeout_min", r"^idle-timeout (?P<value>\d+)", "minutes_from_seconds", within="^user-interface vty"),
    packs.Mapping("mgmt.ssh.version", r"^ssh version (?P<value>\S+)", "to_int"),
    packs.Mapping("logging.level", r"^ssh version (?P<value>\S+)", "identity", 3, 0.5),
    packs.Mapping("mgmt.telnet_enabled", r"^telnet server (?P<value>\w+)", "to_bool"),
    packs.Mapping("mgmt.http_enabled", r"^http blocked (?P<value>\w+)", "invert_yes_no"),
    packs.Mapping("ntp.servers", r"^ntp (?P<value>\S+)", "collect"),
    packs.Mapping("snmp.communities", r"^community (?P<value>\S+)", "collect_redacted"),
    packs.Mapping("aaa.enabled", r"^aaa", "presence"),
    packs.Mapping("services.source_routing", r"^undo source", "negated_presence"),
    packs.Mapping("logging.level", r"^level (?P<value>\w+)", "lookup", values={"4": "warning", "6": "info"}),
), ((r"^sysname", 0.5), (r"^user-interface vty", 0.3)))
#: text, path, value, within a device's numbers: the first mapping whose transform succeeds reads a line
_TAUGHT = [
    ("sysname [[name]]", None, None), ("user-interface vty 0 4", None, None), (" idle-timeout [[60 * q + 1]]", "mgmt.idle_timeout_min", "[[q + 1]]"), ("idle-timeout 99", None, None),
    ("ssh version [[CASE WHEN k % 2 = 0 THEN '2' ELSE 'two' END]]", "[[CASE WHEN k % 2 = 0 THEN 'mgmt.ssh.version' ELSE 'logging.level' END]]", "[[CASE WHEN k % 2 = 0 THEN '2' ELSE 'two' END]]"),
    ("telnet server enable", "mgmt.telnet_enabled", "true"), ("telnet server maybe", None, None), ("http blocked [[CASE WHEN k % 3 = 0 THEN 'yes' ELSE 'no' END]]", "mgmt.http_enabled", "[[CASE WHEN k % 3 = 0 THEN 'false' ELSE 'true' END]]"),
    ('ntp "10.0.0.[[n]]"', "ntp.servers", "10.0.0.[[n]]"), ("community [[CASE WHEN k % 2 = 0 THEN 'Public' ELSE 'hush' END]]", "snmp.communities", "[[CASE WHEN k % 2 = 0 THEN 'default' ELSE 'custom' END]]"),
    ("aaa on", "aaa.enabled", "true"), ("undo source", "services.source_routing", "false"), ("level [[4 + k % 3]]", "[[CASE WHEN k % 3 <> 1 THEN 'logging.level' END]]", "[[CASE WHEN k % 3 = 0 THEN 'warning' ELSE 'info' END]]"), ("#", None, None), ("", None, None), ("exit", None, None),
]


def _taught(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    text = "array_join(array(" + ", ".join(sql_text(t) for t, _, _ in _TAUGHT) + "), '\\n')"
    files = rendered.devices(spark, sf_dir, False).select(F.concat(F.lit("d"), F.col("k").cast("string")).alias("device_id"), F.lit("running").alias("file"), F.lit("config").alias("role"), F.expr(text).alias("text"))
    lines = bundle.lines(files)
    return files, lines, files.select("device_id", F.lit("unknown").alias("vendor"), F.lit(None).cast("string").alias("os"))


_TAUGHT_SQL = "SELECT 'd' || k AS device_id, f.n AS line_no, f.path AS path, f.value AS value FROM (SELECT k, unnest([" + ", ".join(
    f"{{'n': {k}, 'path': {sql_text(p)}, 'value': {sql_text(v)}}}" for k, (_, p, v) in enumerate(_TAUGHT, 1) if p
) + f"]) AS f FROM {ONE}) WHERE f.path IS NOT NULL"


@query(_TAUGHT_SQL)
def pack_facts(spark, sf_dir):
    """What mappings read of lines that no grammar knows: ten transforms, blocks, and the next mapping's
    turn where a transform fails."""
    files, lines, devices = _taught(spark, sf_dir)
    got = packs.apply(lines, devices, [_PACK])
    return got.where("path is not null").select("device_id", F.col("line_no").cast("long").alias("line_no"), "path", "value")


FEATURES = 1000


@query(f"""WITH l AS (SELECT DISTINCT 'd' || l_suppkey AS device_id, concat_ws('-', l_orderkey, l_partkey, CAST(l_quantity AS INTEGER)) AS file, CAST(l_linenumber AS BIGINT) AS line_no, l_partkey % {FEATURES} AS f, l_linenumber % 5 AS kind, CAST(l_quantity AS INTEGER) AS q FROM lineitem)
SELECT device_id, file, line_no, CASE kind WHEN 0 THEN 'mgmt.idle_timeout_min' WHEN 1 THEN 'logging.level' WHEN 2 THEN 'ntp.servers' ELSE 'services.proxy_arp' END AS path, CASE kind WHEN 0 THEN CAST(q AS VARCHAR) WHEN 1 THEN 'l' || q WHEN 2 THEN 's' || q ELSE 'false' END AS value
FROM l WHERE kind < 3 OR kind = 3 AND f % 2 = 0""")
def pack_facts_by_index(spark, sf_dir):
    """Lines read by three and a half thousand mappings, each meeting only those it shares a word or letters with: a
    failed transform leaves a line to a later mapping, blocks and alternatives count, the last kind fits no block."""
    made = []
    for k in range(FEATURES):
        made += [packs.Mapping("mgmt.idle_timeout_min", rf"^feature{k} level (?P<value>\w+)$", "to_int"), packs.Mapping("logging.level", rf"(?i)^FEATURE{k}\s+level\s+(?P<value>\w+)", "identity"), packs.Mapping("ntp.servers", rf"limit{k}=(?P<value>\w+)", "collect")]
        made += [packs.Mapping("services.proxy_arp", rf"^(?:no|undo) feature{k}$", "negated_presence", within="^even")] if k % 2 == 0 else []
    text = "CASE l_linenumber % 5 WHEN 0 THEN 'feature' || f || ' level ' || q WHEN 1 THEN 'feature' || f || ' level l' || q WHEN 2 THEN 'set xlimit' || f || '=s' || q WHEN 3 THEN 'undo feature' || f ELSE 'no feature' || f || ' at all' END"
    rows = table(spark, sf_dir, "lineitem").selectExpr("'d' || l_suppkey AS device_id", "concat_ws('-', l_orderkey, l_partkey, CAST(l_quantity AS INT)) AS file", "l_linenumber AS line_no", f"l_partkey % {FEATURES} AS f", "CAST(l_quantity AS INT) AS q", "l_linenumber").distinct()
    lines = rows.selectExpr("device_id", "file", "line_no", f"{text} AS text", "array('top', IF(f % 2 = 0, 'even', 'odd')) AS context")
    devices = table(spark, sf_dir, "supplier").selectExpr("'d' || s_suppkey AS device_id", "'v' AS vendor", "CAST(NULL AS STRING) AS os")
    got = packs.apply(lines, devices, [packs.Pack("many", "v", None, tuple(made))])
    return got.where("path is not null").select("device_id", "file", F.col("line_no").cast("long").alias("line_no"), "path", "value")


@query("SELECT 'd' || s_suppkey AS device_id, 'unknown' AS vendor FROM supplier")
def pack_names_device(spark, sf_dir):
    """A fingerprint of 0.5 and 0.3 reaches the 0.6 that names a device."""
    files, _, _ = _taught(spark, sf_dir)
    return packs.named(files, [_PACK]).select("device_id", "vendor")


@query("SELECT 'd' || s_suppkey AS device_id, CAST(n AS BIGINT) AS line_no FROM supplier, (VALUES (14), (15), (16)) x(n)")
def structural_lines(spark, sf_dir):
    _, lines, _ = _taught(spark, sf_dir)
    return packs.structural(lines).select("device_id", F.col("line_no").cast("long").alias("line_no"))


@query("""SELECT 'd' || s_suppkey AS device_id, p.pack_id FROM supplier JOIN (VALUES (0, 'cisco'), (1, 'cisco'), (3, 'eos'), (4, 'any'), (5, 'any'), (6, 'any')) p(kind, pack_id) ON s_suppkey % 7 = p.kind""")
def pack_selection(spark, sf_dir):
    """A pack reads devices of its vendor and system; a system that either side leaves open fits."""
    kinds = [("cisco", "IOS"), ("cisco", None), ("cisco", "NX-OS"), ("arista", "EOS"), ("x", "A"), ("x", "B"), ("x", None)]
    one_of = lambda at: "CASE s_suppkey % 7 " + " ".join(f"WHEN {k} THEN '{v[at]}'" for k, v in enumerate(kinds) if v[at]) + " END"
    devices = table(spark, sf_dir, "supplier").selectExpr("concat('d', s_suppkey) AS device_id", f"{one_of(0)} AS vendor", f"{one_of(1)} AS os")
    lines = devices.select("device_id", F.lit("f").alias("file"), F.lit(1).alias("line_no"), F.lit("known").alias("raw"), F.lit("known").alias("text"), F.lit(0).alias("indent"))
    one = (packs.Mapping("aaa.enabled", "^known", "presence"),)
    made = [packs.Pack("any", "x", None, one), packs.Pack("cisco", "cisco", "IOS", one), packs.Pack("eos", "arista", "EOS", one)]
    return packs.apply(lines, devices, made).select("device_id", F.col("pack").alias("pack_id"))


@query(f"{_WITH} SELECT device_id, CASE vendor WHEN 'juniper' THEN 'brace' WHEN 'mikrotik' THEN 'flat' WHEN 'paloalto' THEN 'xml' ELSE 'indent' END AS grammar FROM devices")
def block_grammar(spark, sf_dir):
    a = fleet(spark, sf_dir)
    return packs.grammar(a.lines.where("role = 'config'")).select("device_id", "grammar")


@query(f"SELECT 'd' || k AS device_id, line_no, context FROM ({rendered.FLEET_CONTEXTS})")
def structure_tree(spark, sf_dir):
    """The enclosing headers of every line of the fleet, in braces, indents, flat paths and XML."""
    a = fleet(spark, sf_dir)
    return packs.tree(a.lines.where("role = 'config'")).select("device_id", F.col("line_no").cast("long").alias("line_no"), F.array_join("context", " / ").alias("context"))


@query(f"{_WITH} SELECT device_id, count(*) AS total_lines, CAST(0 AS BIGINT) AS tier0 FROM lines WHERE vendor = 'cisco' GROUP BY device_id")
def held_out_vendor(spark, sf_dir):
    """Without its parser a vendor's lines are read by no grammar."""
    a = fleet(spark, sf_dir)
    lines = a.lines.where("role = 'config'").join(a.devices.where("vendor = 'cisco'").select("device_id"), "device_id")
    facts = parsing.parse(lines, a.devices, hold_out=("cisco",))
    return documents.coverage(lines, facts).select("device_id", "total_lines", "tier0")


# -- drift and accuracy ---------------------------------------------------------------------------


def _changed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Verdicts and facts of the fleet a day later: Telnet is on everywhere, idle facts are lost, one more server."""
    a = fleet(spark, sf_dir)
    v = F.when(F.col("rule_id") == "CIS-NET-1.1.1", "fail").when((F.col("rule_id") == "CIS-NET-1.3.1") & (F.col("verdict") == "fail"), "pass").when(F.col("rule_id") == "CIS-NET-5.3.1", "not_applicable").otherwise(F.col("verdict"))
    facts = a.facts.where("path is null or path <> 'mgmt.idle_timeout_min'").withColumn("value", F.when(F.col("path") == "mgmt.telnet_enabled", "true").when(F.col("path") == "ntp.servers", F.concat("value", F.lit("9"))).otherwise(F.col("value")))
    return a.findings.withColumn("verdict", v), facts


@query(f"""{_VERDICTS}, later AS (SELECT device_id, rule_id, verdict AS b, CASE rule_id WHEN 'CIS-NET-1.1.1' THEN 'fail' WHEN 'CIS-NET-5.3.1' THEN 'absent' WHEN 'CIS-NET-1.3.1' THEN CASE verdict WHEN 'fail' THEN 'pass' ELSE verdict END ELSE verdict END AS a FROM verdicts)
SELECT device_id, rule_id, b AS before, a AS after, CASE WHEN a = 'fail' THEN 'regression' WHEN b = 'fail' AND a = 'pass' THEN 'improvement' ELSE 'other' END AS change FROM later WHERE a <> b""")
def fleet_verdict_drift(spark, sf_dir):
    return drift.verdict_changes(fleet(spark, sf_dir).findings, _changed(spark, sf_dir)[0])


@query(f"""{_DOCS} SELECT device_id, 'mgmt.telnet_enabled' AS ir_path, 'false' AS before, 'true' AS after FROM docs WHERE NOT telnet UNION ALL SELECT device_id, 'mgmt.idle_timeout_min', CAST(idle AS VARCHAR), NULL FROM docs WHERE idle IS NOT NULL
UNION ALL SELECT device_id, 'ntp.servers', array_to_string(ntp_servers, ','), array_to_string(ntp_servers, ',') || '9' FROM docs WHERE ntp_servers IS NOT NULL""")
def fleet_fact_drift(spark, sf_dir):
    return drift.fact_changes(fleet(spark, sf_dir).facts, _changed(spark, sf_dir)[1]).select("device_id", "ir_path", "before", "after")


def _members_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts a day later: other lists on interfaces, lesser accounts, entries that permit, another address, and no
    descriptions any more."""
    path, value = F.col("path"), F.col("value")
    new = F.when((path == "interfaces.acl_in") & (value == "MGMT"), "NEW").when((path == "aaa.local_users.privilege") & (value == "15"), "1").when((path == "acls.entries.action") & (value == "deny"), "permit")
    new = new.when((path == "interfaces.addresses") & value.endswith("/24") & value.startswith("10."), F.concat(value, F.lit("9"))).otherwise(value)
    return fleet(spark, sf_dir).facts.where("path is null or path <> 'interfaces.description'").withColumn("value", new)


#: What these changes are by device, from what its lines mean; v is the vendor's number.
_MEMBERS = """WITH d AS (SELECT 'd' || s_suppkey AS device_id, s_suppkey % 6 AS v, s_nationkey AS nat, s_suppkey % 250 + 1 AS n FROM supplier)
SELECT device_id, 'interfaces[1].acl_in' AS ir_path, 'MGMT' AS before, 'NEW' AS after FROM d WHERE v = 0
UNION ALL SELECT device_id, 'aaa.local_users[0].privilege', '15', '1' FROM d WHERE v IN (0, 1)
UNION ALL SELECT device_id, 'acls[0].entries[' || i || '].action', 'deny', 'permit' FROM d, (VALUES (1), (4), (6)) x(i) WHERE v = 0
UNION ALL SELECT device_id, 'interfaces[' || CASE v WHEN 1 THEN 0 WHEN 5 THEN 0 ELSE 1 END || '].addresses', a, a || '9' FROM (SELECT *, '10.' || nat || '.' || CASE v WHEN 0 THEN '9' WHEN 5 THEN '7' ELSE '0' END || '.' || n || '/24' AS a FROM d WHERE v IN (0, 1, 2, 5))
UNION ALL SELECT device_id, 'interfaces[0].description', CASE v WHEN 0 THEN 'uplink to internet' WHEN 2 THEN 'wan' WHEN 3 THEN 'management lan' WHEN 4 THEN 'wan side' ELSE 'dedicated management port' END, NULL FROM d WHERE v <> 1"""


@query(_MEMBERS)
def fleet_list_drift(spark, sf_dir):
    """Changes inside lists, index by index, from two tables of facts."""
    return drift.fact_changes(fleet(spark, sf_dir).facts, _members_changed(spark, sf_dir)).select("device_id", "ir_path", "before", "after")


@query(_MEMBERS)
def fleet_document_drift(spark, sf_dir):
    """The same from two tables of documents, flattened to paths."""
    a = fleet(spark, sf_dir)
    return drift.document_changes(a.documents, documents.documents(_members_changed(spark, sf_dir), a.devices))


@query(_MEMBERS)
def fleet_written_drift(spark, sf_dir):
    """And from documents as they are written, in canonical JSON, read without a schema."""
    from plumbline.operators.ledger import canonical_json

    a = fleet(spark, sf_dir)
    text = lambda df: df.select("device_id", canonical_json(F.struct(*(c for c in df.columns if c != "device_id")), StructType([f for f in df.schema if f.name != "device_id"])).alias("value"))
    return drift.written_document_changes(text(a.documents), text(documents.documents(_members_changed(spark, sf_dir), a.devices)))


@query("""WITH d AS (SELECT s_suppkey % 6 AS v FROM supplier), c AS (SELECT count(*) AS n, count(*) FILTER (v = 0) AS acl, count(*) FILTER (v < 2) AS level, count(*) FILTER (v IN (0, 1, 2, 4)) AS ops, count(*) FILTER (v = 1) AS cited FROM d)
SELECT 3 * n AS facts, acl + level + ops AS right, round_even((acl + level + ops) / (3 * n)::DOUBLE, 6)::DOUBLE AS fact_accuracy, round_even(cited / ops::DOUBLE, 6)::DOUBLE AS citation_agreement FROM c""")
def list_fact_accuracy(spark, sf_dir):
    """Labels of members: an interface's list, an account's level and its name with its line."""
    a = fleet(spark, sf_dir)
    truth = spark.createDataFrame([("interfaces[1].acl_in", "MGMT", None), ("aaa.local_users[0].privilege", "15", None), ("aaa.local_users[0].name", "ops", 4)], "ir_path string, value string, line int")
    return validation.fact_accuracy(a.facts, a.devices.select("device_id").crossJoin(F.broadcast(truth)))


@query(f"""{_VERDICTS}, labels AS (SELECT device_id, rule_id, verdict, CASE WHEN rule_id = 'CIS-NET-1.1.1' THEN 'fail' WHEN rule_id = 'CIS-NET-1.2.4' THEN 'pass' WHEN rule_id = 'CIS-NET-4.1.1' THEN 'fail' ELSE 'unknown' END AS expected FROM verdicts WHERE rule_id IN ('CIS-NET-1.1.1', 'CIS-NET-1.2.4', 'CIS-NET-4.1.1', 'CIS-NET-5.3.1')),
c AS (SELECT count(*) FILTER (WHERE expected = 'fail' AND verdict = 'fail') AS tp, count(*) FILTER (WHERE expected = 'pass' AND verdict = 'fail') AS fp, count(*) FILTER (WHERE expected = 'fail' AND verdict = 'pass') AS fn, count(*) FILTER (WHERE expected = 'fail' AND verdict = 'unknown') AS cautious,
count(*) FILTER (WHERE verdict = expected) AS same, count(*) FILTER (WHERE verdict = 'unknown') AS unknown, count(*) AS n FROM labels)
SELECT tp, fp, fn, cautious, round_even(tp / (tp + fp)::DOUBLE, 6)::DOUBLE AS precision, round_even(tp / (tp + fn + cautious)::DOUBLE, 6)::DOUBLE AS recall, round_even(same / n::DOUBLE, 6)::DOUBLE AS verdict_agreement, round_even(unknown / n::DOUBLE, 6)::DOUBLE AS verdict_unknown_rate FROM c""")
def verdict_accuracy(spark, sf_dir):
    found = fleet(spark, sf_dir).findings
    expected = F.when(F.col("rule_id") == "CIS-NET-1.2.4", "pass").when(F.col("rule_id") == "CIS-NET-5.3.1", "unknown").otherwise("fail")
    labels = found.where(F.col("rule_id").isin("CIS-NET-1.1.1", "CIS-NET-1.2.4", "CIS-NET-4.1.1", "CIS-NET-5.3.1")).select("device_id", "rule_id", expected.alias("expected"))
    return validation.verdicts(found, labels).select("tp", "fp", "fn", "cautious", "precision", "recall", "verdict_agreement", "verdict_unknown_rate")


@query(f"""{_WITH}, said AS (SELECT d.device_id, p.path, p.value AS value, p.line AS line, f.value AS said, f.line_no AS found_at FROM devices d, (VALUES ('mgmt.telnet_enabled', 'true', 20), ('mgmt.ssh.enabled', 'true', NULL), ('snmp.acl', NULL, NULL)) p(path, value, line)
LEFT JOIN (SELECT device_id, path, arg_max(value, line_no) AS value, max(line_no) AS line_no FROM facts GROUP BY device_id, path) f ON f.device_id = d.device_id AND f.path = p.path)
SELECT count(*) AS facts, count(*) FILTER (WHERE value IS NOT DISTINCT FROM said) AS right, round_even(count(*) FILTER (WHERE value IS NOT DISTINCT FROM said) / count(*)::DOUBLE, 6)::DOUBLE AS fact_accuracy,
round_even(coalesce(count(*) FILTER (WHERE value = said AND line = found_at) / nullif(count(*) FILTER (WHERE value = said AND line IS NOT NULL), 0)::DOUBLE, 0), 6)::DOUBLE AS citation_agreement FROM said""")
def fact_accuracy(spark, sf_dir):
    a = fleet(spark, sf_dir)
    truth = spark.createDataFrame([("mgmt.telnet_enabled", "true", 20), ("mgmt.ssh.enabled", "true", None), ("snmp.acl", None, None)], "ir_path string, value string, line int")
    return validation.fact_accuracy(a.facts, a.devices.select("device_id").crossJoin(F.broadcast(truth)))


@query(f"""{_WITH}, every AS (SELECT device_id, claimed FROM lines UNION ALL SELECT device_id, true FROM devices, range(3) WHERE vendor = 'cisco'),
p AS (SELECT round_even(100.0 * count(*) FILTER (WHERE claimed) / count(*), 1)::DOUBLE AS percent FROM every GROUP BY device_id) SELECT round_even(avg(percent), 1)::DOUBLE AS mean_coverage FROM p""")
def mean_coverage(spark, sf_dir):
    return validation.mean_coverage(fleet(spark, sf_dir).coverage)
