"""Queries of the fleet graph over documents that are made of the supplier table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import rendered
from plumbline.functions import scalars
from plumbline.operators import fleet
from plumbline.registry import query, table

#: place, name, address, description, zone, list, shutdown, is_mgmt of a device's interfaces, in both dialects
_IFACES = [
    ("wan0", "CASE WHEN k % 6 = 1 THEN '8.8.' || (k % 7) || '.' || n ELSE '198.18.' || (k % 7) || '.' || n END", "CASE WHEN k % 5 = 0 THEN 'isp uplink' END", "CASE WHEN k % 4 = 1 THEN 'IN' END", "k % 11 = 3", "false"),
    ("lan0", "'10.' || nat || '.0.' || n || '/24'", "'users'", "CASE WHEN k % 4 = 2 THEN 'IN' END", "false", "false"),
    ("mg0", "'192.168.' || (k % 3) || '.' || n", "NULL", "NULL", "false", "k % 2 = 0"),
    ("core0", "CASE WHEN k % 10 = 0 THEN '192.168.200.' || n || '/16' WHEN k % 10 = 5 THEN '192.168.1.' || n || '/24' END", "NULL", "NULL", "false", "false"),
    ("six0", "'2001:db8:' || (nat + 1) || '::' || n || '/64'", "NULL", "NULL", "false", "false"),
    ("six1", "'2001:DB8:' || (nat + 1) || ':0:0:0:' || n || ':1'", "NULL", "NULL", "false", "false"),
]
#: seq, action, protocol, src, dst, dst_port
_ENTRIES = [
    (10, "deny", "tcp", "'any'", "'any'", "'eq telnet'"), (20, "permit", "tcp", "'10.0.0.0/8'", "'any'", "NULL"), (30, "deny", "tcp", "CASE WHEN k % 2 = 0 THEN '10.7.0.0/16' ELSE '11.7.0.0/16' END", "'any'", "'eq 22'"),
    (35, "remark", "ip", "'any'", "'any'", "NULL"), (40, "permit", "udp", "'2001:db8::/32'", "'any'", "'1-99'"), (50, "permit", "udp", "'2001:db8:5::/48'", "'any'", "'1-99'"), (60, "permit", "tcp", "'any'", "'any'", "NULL"),
]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda x: f"CAST({x} AS STRING)"
    one = lambda i: f"named_struct('name', '{i[0]}', 'description', {s(i[2])}, 'addresses', CASE WHEN {i[1]} IS NOT NULL THEN array({i[1]}) ELSE CAST(array() AS array<string>) END, 'acl_in', {s(i[3])}, 'acl_out', {s('NULL')}, 'zone', {s('NULL')}, 'vlan', CAST(NULL AS INT), 'shutdown', {i[4]}, 'is_mgmt', {i[5]})"
    entry = lambda e: f"named_struct('seq', {e[0]}, 'action', '{e[1]}', 'protocol', '{e[2]}', 'src', {s(e[3])}, 'dst', {s(e[4])}, 'src_port', {s('NULL')}, 'dst_port', {s(e[5])}, 'log', false, 'raw', '{e[1]} {e[0]}', 'match', '')"
    return rendered.devices(spark, sf_dir, False).selectExpr(
        "'d' || k AS device_id", "named_struct('vendor', 'x', 'hostname', name) AS device",
        "named_struct('mgmt_acl', CASE WHEN k % 3 = 0 THEN 'M' END, 'telnet_enabled', k % 4 = 0, 'http_enabled', k % 5 = 0, 'https_enabled', CAST(NULL AS BOOLEAN), 'ssh', named_struct('enabled', true)) AS mgmt",
        "named_struct('servers', array('10.0.0.20'), 'local_users', array(named_struct('name', 'ops', 'privilege', 15, 'hash', 'md5', 'hash_fingerprint', CASE WHEN k % 2 = 0 THEN 'fp' || (k % 9) || '-0123456' END))) AS aaa",
        "named_struct('servers', array('10.0.' || nat || '.1'), 'authenticated', k % 4 = 0) AS ntp", "named_struct('servers', CASE WHEN k % 2 = 0 THEN array('10.0.0.5') END) AS logging",
        f"array({', '.join(map(one, _IFACES))}) AS interfaces", f"array(named_struct('name', 'IN', 'entries', array({', '.join(map(entry, _ENTRIES))}))) AS acls",
    )


_HELD: dict[tuple[str, str], DataFrame] = {}


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _HELD:
        _HELD[key] = fleet.graph(_docs(spark, sf_dir))
    return _HELD[key]


_STRUCTS = ", ".join(f"{{'place': {p}, 'name': '{i[0]}', 'address': {i[1]}, 'about': {i[2]}, 'acl': {i[3]}, 'down': {i[4]}, 'mgmt': {i[5]}}}" for p, i in enumerate(_IFACES))
_WITH = f"""WITH RECURSIVE dev AS (SELECT {rendered.NUMBERS} FROM supplier),
ifaces AS (SELECT 'd' || k AS device_id, k, nat, u.* FROM (SELECT k, nat, unnest([{_STRUCTS}]) AS u FROM dev)),
v4 AS (SELECT *, CAST(split_part(a, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(a, '.', 2) AS BIGINT) * 65536 + CAST(split_part(a, '.', 3) AS BIGINT) * 256 + CAST(split_part(a, '.', 4) AS BIGINT) AS ip,
  CASE WHEN contains(address, '/') THEN CAST(split_part(address, '/', 2) AS INTEGER) END AS len FROM (SELECT *, split_part(address, '/', 1) AS a FROM ifaces WHERE address LIKE '%.%')),
declared AS (SELECT device_id AS d, place AS p, ip // (1::BIGINT << (32 - len)) AS bits, len AS dlen FROM v4 WHERE len IS NOT NULL),
joined AS (SELECT v4.*, arg_min({{'bits': bits, 'len': dlen}}, {{'d': d, 'p': p}}) AS net FROM v4 LEFT JOIN declared ON v4.len IS NULL AND v4.ip // (1::BIGINT << (32 - dlen)) = bits GROUP BY ALL),
nets AS (SELECT *, len IS NULL AS inferred, coalesce(len, net.len, 24) AS l FROM joined),
based AS (SELECT *, (ip // (1::BIGINT << (32 - l))) * (1::BIGINT << (32 - l)) AS base FROM nets),
m AS (SELECT device_id, k, place, name, about, acl, down, mgmt, inferred, (base // 16777216) || '.' || (base // 65536 % 256) || '.' || (base // 256 % 256) || '.' || (base % 256) || '/' || l AS segment, base // 16777216 = 8 AS outside FROM based
  UNION ALL SELECT device_id, k, place, name, about, acl, down, mgmt, name = 'six1', '2001:db8:' || (nat + 1) || '::/64', false FROM ifaces WHERE name LIKE 'six%'),
members AS (SELECT device_id, k, place, name, segment, inferred, down, acl, CASE WHEN mgmt THEN 'management' WHEN coalesce(about LIKE '%isp%', false) OR outside THEN 'untrusted' ELSE 'internal' END AS trust FROM m),
ports(port) AS (VALUES (23), (80), (443), (22)),
ways AS (SELECT * FROM members, ports WHERE NOT down AND NOT (acl IS NOT NULL AND port = 23)),
starts AS (SELECT DISTINCT segment AS start FROM members WHERE trust = 'untrusted' AND NOT down),
reach(start, port, segment, depth) AS (SELECT start, port, start, 0 FROM starts, ports UNION SELECT r.start, r.port, o.segment, r.depth + 1 FROM reach r JOIN ways w ON w.segment = r.segment AND w.port = r.port JOIN members o ON o.device_id = w.device_id AND o.place <> w.place AND NOT o.down WHERE r.depth < 5),
least AS (SELECT start, port, segment, min(depth) AS depth FROM reach GROUP BY ALL),
arrivals AS (SELECT l.start, l.port, w.device_id, min(l.depth) AS depth FROM least l JOIN ways w ON w.segment = l.segment AND w.port = l.port GROUP BY ALL),
entries AS (SELECT segment AS start, device_id AS d, name AS at_name FROM members WHERE trust = 'untrusted' AND NOT down QUALIFY row_number() OVER (PARTITION BY segment ORDER BY device_id, place) <= 8),
open AS (SELECT 'd' || k AS device_id, name, s.service AS service, s.port AS port FROM (SELECT k, name, unnest([{{'service': 'telnet', 'port': 23, 'on': k % 4 = 0}}, {{'service': 'http', 'port': 80, 'on': k % 5 = 0}}, {{'service': 'ssh', 'port': 22, 'on': true}}]) AS s FROM dev WHERE k % 3 <> 0) WHERE s.on),
exposed AS (SELECT device_id, name, service, count(DISTINCT d || ':' || at_name) AS sources, count(*) AS paths FROM open JOIN arrivals USING (device_id, port) JOIN entries USING (start) GROUP BY ALL)"""


@query(f"{_WITH} SELECT device_id, place, name, segment, inferred FROM members")
def graph_segments(spark, sf_dir):
    """Interfaces in networks: declared, joined by a bare address, or the usual size; both IP versions."""
    return _members(spark, sf_dir).select("device_id", "place", "name", "segment", "inferred")


@query(f"{_WITH} SELECT device_id, name, trust FROM members UNION ALL SELECT device_id, name, 'internal' FROM ifaces WHERE address IS NULL")
def graph_trust(spark, sf_dir):
    return fleet.classified(_docs(spark, sf_dir), _members(spark, sf_dir)).select("device_id", "name", "trust")


_NODES = f"""{_WITH}, creds AS (SELECT 'fp' || (k % 9) || '-0123456' AS f, count(*) AS n FROM dev WHERE k % 2 = 0 GROUP BY 1 HAVING count(*) >= 2),
leans AS (SELECT DISTINCT 'device:d' || k AS src, 'service:' || unnest([CASE WHEN k % 2 = 0 THEN 'syslog:10.0.0.5' END, 'ntp:10.0.' || nat || '.1', 'aaa:10.0.0.20']) AS service FROM dev),
nodes AS (SELECT 'device:d' || k AS id, 'device' AS kind, name AS label FROM dev UNION ALL SELECT 'iface:' || device_id || ':' || name, 'interface', name FROM ifaces UNION ALL SELECT DISTINCT 'segment:' || segment, 'segment', segment FROM members
  UNION ALL SELECT DISTINCT service, 'service', replace(replace(service, 'service:', ''), ':', ' ') FROM leans WHERE service IS NOT NULL UNION ALL SELECT 'credential:' || f, 'credential', left(f, 8) FROM creds),
edges AS (SELECT 'device:' || device_id AS src, 'iface:' || device_id || ':' || name AS dst FROM ifaces UNION ALL SELECT 'iface:' || device_id || ':' || name, 'segment:' || segment FROM members UNION ALL SELECT src, service FROM leans WHERE service IS NOT NULL
  UNION ALL SELECT 'device:d' || k, 'credential:fp' || (k % 9) || '-0123456' FROM dev WHERE k % 2 = 0 AND 'fp' || (k % 9) || '-0123456' IN (SELECT f FROM creds))"""


@query(f"{_NODES} SELECT id, kind, label FROM nodes")
def graph_nodes(spark, sf_dir):
    return fleet.nodes(_docs(spark, sf_dir), _members(spark, sf_dir))


@query(f"{_NODES} SELECT src, dst FROM edges")
def graph_edges(spark, sf_dir):
    return fleet.edges(_docs(spark, sf_dir), _members(spark, sf_dir)).select("src", "dst")


@query(f"{_NODES}, ends AS (SELECT src AS id, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges) SELECT id, count(DISTINCT other) AS n FROM ends WHERE id LIKE 'segment:%' OR id LIKE 'device:%' GROUP BY id")
def graph_neighbours(spark, sf_dir):
    docs, held = _docs(spark, sf_dir), _members(spark, sf_dir)
    of = fleet.nodes(docs, held).where("kind in ('segment', 'device')")
    return fleet.neighbours(fleet.edges(docs, held), of).groupBy("id").agg(F.count("*").alias("n"))


@query(f"{_NODES} SELECT src, service FROM leans WHERE service IS NOT NULL")
def graph_trusted_services(spark, sf_dir):
    return fleet.trusts(_docs(spark, sf_dir))


@query(f"{_WITH}, own AS (SELECT segment, device_id, count(*) AS n FROM members GROUP BY ALL) SELECT segment, CAST(sum(n) AS BIGINT) AS interfaces, count(*) AS devices, CAST((sum(n) * (sum(n) - 1) - sum(n * (n - 1))) / 2 AS BIGINT) AS links FROM own GROUP BY segment")
def graph_segment_classes(spark, sf_dir):
    """Adjacency by classes: a segment, its interfaces, and how many pairs of them are adjacent."""
    return fleet.segments(_docs(spark, sf_dir), _members(spark, sf_dir))


@query(f"{_WITH} SELECT a.device_id || ':' || a.name AS a, b.device_id || ':' || b.name AS b, segment FROM members a JOIN members b USING (segment) WHERE (a.device_id, a.place) < (b.device_id, b.place) AND a.device_id <> b.device_id AND segment LIKE '10.%'")
def graph_adjacency(spark, sf_dir):
    """Pairs of interfaces on one user segment; a segment of over a thousand interfaces would raise."""
    docs, held = _docs(spark, sf_dir), _members(spark, sf_dir)
    return fleet.adjacency(docs, 1000, held.where("segment like '10.%'"))


@query("""WITH h AS (SELECT 'fp' || (s_suppkey % 9) || '-0123456' AS fingerprint, 'd' || s_suppkey AS d FROM supplier WHERE s_suppkey % 2 = 0)
SELECT fingerprint, count(*) AS n_accounts, count(DISTINCT d) AS n_devices, array_to_string((list(d ORDER BY d))[1:12], ',') AS devices FROM h GROUP BY fingerprint HAVING count(*) >= 2""")
def graph_credentials(spark, sf_dir):
    return fleet.credentials(_docs(spark, sf_dir)).select("fingerprint", "n_accounts", "n_devices", F.array_join("devices", ",").alias("devices"))


@query("SELECT 'd' || s_suppkey AS device_id, port, port <> 23 AS permitted FROM supplier, (VALUES (22), (23), (80), (443)) x(port)")
def access_list_permits(spark, sf_dir):
    """The first entry that decides, in its order; sources don't count, remarks decide nothing."""
    rows = _docs(spark, sf_dir).select("device_id", F.get("acls", F.lit(0))["entries"].alias("e"), F.explode(F.array(*map(F.lit, (22, 23, 80, 443)))).alias("port"))
    return rows.select("device_id", "port", fleet.permits(F.col("e"), F.col("port")).alias("permitted"))


@query(f"{_WITH} SELECT start, d AS \"from\", at_name AS \"at\" FROM entries")
def graph_entry_points(spark, sf_dir):
    return fleet.entry_groups(_members(spark, sf_dir))


@query(f"{_WITH} SELECT start, port, device_id, depth FROM arrivals")
def graph_sweeps(spark, sf_dir):
    """First arrivals breadth first, by start segment and port."""
    return fleet.sweeps(_members(spark, sf_dir)).select("start", "port", "device_id", "depth")


def _levels(n: int) -> str:
    """Sweeps level by level: of the ways to a segment that is new the first in the order of all steps so far."""
    out = ["l0 AS (SELECT start, port, start AS segment, [start] AS hops, false AS inf, []::STRUCT(d VARCHAR, p INTEGER, o INTEGER)[] AS ord FROM starts, ports)", "s0 AS (SELECT start, port, segment FROM l0)"]
    for k in range(n):
        out.append(f"h{k} AS MATERIALIZED (SELECT l.start, l.port, w.device_id, w.name, w.place, l.hops, l.inf OR w.inferred AS inf, l.ord, {k} AS depth FROM l{k} l JOIN ways w ON w.segment = l.segment AND w.port = l.port)")
        if k < n - 1:
            out.append(f"""l{k + 1} AS MATERIALIZED (SELECT * FROM (SELECT h.start, h.port, o.segment, list_concat(h.hops, [h.device_id || ':' || o.name, o.segment]) AS hops, h.inf OR o.inferred AS inf, list_append(h.ord, {{'d': h.device_id, 'p': CAST(h.place AS INTEGER), 'o': CAST(o.place AS INTEGER)}}) AS ord
  FROM h{k} h JOIN members o ON o.device_id = h.device_id AND o.place <> h.place AND NOT o.down ANTI JOIN s{k} s ON s.start = h.start AND s.port = h.port AND s.segment = o.segment) QUALIFY row_number() OVER (PARTITION BY start, port, segment ORDER BY ord) = 1),
s{k + 1} AS MATERIALIZED (SELECT * FROM s{k} UNION ALL SELECT start, port, segment FROM l{k + 1})""")
    return ", ".join(out) + ", found AS (" + " UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(n)) + ")"


@query(f"""{_WITH}, {_levels(fleet.HOPS)} SELECT start, port, device_id, name AS interface, array_to_string(list_append(hops, device_id || ':' || name), ' > ') AS hops, inf AS inferred
FROM found QUALIFY row_number() OVER (PARTITION BY start, port, device_id ORDER BY depth, ord, place) = 1""")
def graph_sweep_hops(spark, sf_dir):
    """The way of each first arrival, and whether a step of it is inferred."""
    return fleet.sweeps(_members(spark, sf_dir)).select("start", "port", "device_id", "interface", F.array_join("hops", " > ").alias("hops"), "inferred")


_TITLE = "name || ': ' || service || ' management is reachable from ' || sources || ' untrusted entry point' || CASE WHEN sources = 1 THEN '' ELSE 's' END"


@query(f"{_WITH} SELECT upper('FLEET-EXPOSURE-' || device_id || '-' || service) AS id, {_TITLE} AS title, CAST(least(paths, 10) AS INTEGER) AS paths, CAST(1 + least(sources, 3) AS INTEGER) AS evidence FROM exposed")
def graph_exposures(spark, sf_dir):
    found = fleet.exposures(_docs(spark, sf_dir), _members(spark, sf_dir))
    return found.select("id", "title", F.size("paths").alias("paths"), F.size("evidence").alias("evidence"))


@query("""WITH w AS (SELECT 'd' || s_suppkey AS d, s_suppkey % 4 = 0 AS yes FROM supplier) SELECT 'FLEET-NTP-DRIFT' AS id, count(*) FILTER (WHERE yes) || ' devices authenticate NTP and ' || count(*) FILTER (WHERE NOT yes) || ' don''t, so their clocks, and logs, can be told apart by nobody.' AS summary,
array_to_string((list(d ORDER BY d) FILTER (WHERE NOT yes))[1:12], ',') AS devices FROM w HAVING count(*) FILTER (WHERE yes) > 0 AND count(*) FILTER (WHERE NOT yes) > 0""")
def graph_ntp_drift(spark, sf_dir):
    return fleet.ntp_drift(_docs(spark, sf_dir)).select("id", "summary", F.array_join("devices", ",").alias("devices"))


_SHADOWS = """(SELECT 'd' || s_suppkey AS device_id, 30 AS late, 20 AS early, 'high' AS severity FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'd' || s_suppkey, 50, 40, 'medium' FROM supplier UNION ALL SELECT 'd' || s_suppkey, 60, 35, 'high' FROM supplier
UNION ALL SELECT 'd' || s_suppkey, 40, 35, 'high' FROM supplier UNION ALL SELECT 'd' || s_suppkey, 50, 35, 'high' FROM supplier)"""
_FIRST = f"(SELECT device_id, late, min(early) AS early, arg_min(severity, early) AS severity FROM {_SHADOWS} GROUP BY ALL)"


@query(f"SELECT 'FLEET-SHADOW-' || device_id || '-IN-' || late AS id, severity, early AS covered_by FROM {_FIRST}")
def graph_shadows(spark, sf_dir):
    """Entries that an earlier one covers: the first such counts."""
    return fleet.shadows(_docs(spark, sf_dir)).select("id", "severity", "covered_by")


_FOUND = f"""{_WITH}, found AS (SELECT upper('FLEET-EXPOSURE-' || device_id || '-' || service) AS id, 'critical' AS severity, least(paths, 10) AS paths FROM exposed UNION ALL SELECT 'FLEET-NTP-DRIFT', 'high', 0 FROM dev HAVING count(*) FILTER (WHERE k % 4 = 0) > 0 AND count(*) FILTER (WHERE k % 4 <> 0) > 0
UNION ALL SELECT 'FLEET-CREDENTIAL-' || left('fp' || (k % 9) || '-0123456', 8), 'high', 0 FROM dev WHERE k % 2 = 0 GROUP BY k % 9 HAVING count(*) >= 2 UNION ALL SELECT 'FLEET-SHADOW-' || device_id || '-IN-' || late, severity, 0 FROM {_FIRST})"""
_BY = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, id"


@query(f"{_FOUND} SELECT id, severity, row_number() OVER (ORDER BY {_BY}) AS place FROM found")
def graph_correlations(spark, sf_dir):
    """All findings, worst first: their order is numbered by partitions of severity, which are few."""
    found = fleet.correlations(_docs(spark, sf_dir), _members(spark, sf_dir)).select("id", "severity")
    order = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).otherwise(2)
    from pyspark.sql import Window as W

    counts = found.groupBy("severity").count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # three rows
    inside = found.withColumn("n", F.row_number().over(W.partitionBy("severity").orderBy("id")))
    return inside.join(F.broadcast(counts), "severity").select("id", "severity", (F.col("before") + F.col("n")).cast("long").alias("place"))


@query(f"""{_FOUND}, targets AS (SELECT 'mgmt-acl:' || device_id AS fix, 'critical' AS severity, 'CIS-NET-1.4.1' AS rule_id, CAST(sum(least(paths, 10)) AS INTEGER) AS paths_severed FROM exposed GROUP BY device_id),
others AS (SELECT id, severity, CASE WHEN id LIKE 'FLEET-CRED%' THEN 'CIS-NET-5.1.1' WHEN id = 'FLEET-NTP-DRIFT' THEN 'CIS-NET-4.1.1' END, 0 FROM found WHERE id NOT LIKE 'FLEET-EXPOSURE%'), every AS (SELECT * FROM targets UNION ALL SELECT * FROM others)
SELECT fix, severity, rule_id, paths_severed, paths_severed * 10 + CASE severity WHEN 'critical' THEN 8 WHEN 'high' THEN 5 ELSE 2 END AS score FROM every""")
def graph_fixes(spark, sf_dir):
    ranked = fleet.rank(fleet.correlations(_docs(spark, sf_dir), _members(spark, sf_dir)))
    return ranked.where("fix not like 'filter:%'").select("fix", "severity", "rule_id", "paths_severed", "score")


@query(f"""{_FOUND} SELECT count(*) AS findings, {', '.join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ('critical', 'high', 'medium', 'low'))}, CAST(sum(paths) AS BIGINT) AS attack_paths FROM found""")
def graph_headline(spark, sf_dir):
    found = fleet.correlations(_docs(spark, sf_dir), _members(spark, sf_dir))
    return fleet.headline(found).drop("headline")


@query(f"{_FOUND} SELECT '# Fleet' AS title, CAST(least(count(*), 200) AS BIGINT) AS listed FROM found")
def fleet_report(spark, sf_dir):
    text = F.col("report")
    rows = fleet.report(fleet.correlations(_docs(spark, sf_dir), _members(spark, sf_dir)))
    return rows.select(F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"), F.regexp_count(text, F.lit(r"(?m)^- \*\*")).cast("long").alias("listed"))


# -- addresses ------------------------------------------------------------------------------------


@query("""SELECT e.event_id, (user_id % 256) || '.' || (event_id % 256) || '.0.0/16' AS net, CASE WHEN event_id % 3 = 0 THEN '2001:db8::' || CAST(1 + event_id % 9 AS VARCHAR) ELSE '2001:db8:0:1::' END AS v6, CAST(24 AS INTEGER) AS wild, CASE WHEN event_id % 2 = 0 THEN 22 END AS mask
FROM events e""")
def address_functions(spark, sf_dir):
    """Networks of addresses, the usual text of IPv6, prefixes of masks and wildcards."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "(user_id % 256) || '.' || (event_id % 256) || '.' || (event_id % 200) || '.7' AS a", "CASE WHEN event_id % 3 = 0 THEN '2001:DB8:0:0:0:0:0:000' || (1 + event_id % 9) ELSE '2001:db8:0:1:0:0:0:0' END AS b")
    digits = scalars.address_digits(F.col("a"))
    net = F.concat(scalars.digits_address(F.rpad(scalars.leading_bits(digits, F.lit(16)), 8, "0")), F.lit("/16"))
    mask = F.when(F.col("event_id") % 2 == 0, "255.255.252.0").otherwise("255.0.255.0")
    return rows.select("event_id", net.alias("net"), scalars.digits_address(scalars.address_digits(F.col("b"))).alias("v6"), scalars.wildcard_prefix(F.lit("0.0.0.255")).alias("wild"), scalars.mask_prefix(mask).alias("mask"))
