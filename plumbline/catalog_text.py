"""Queries of scalar functions, learning, the ledger, benchmarks and sources, over rows of the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import rendered
from plumbline.functions import ed25519, scalars
from plumbline.operators import drift, learning, ledger, packs, relational
from plumbline.plans import rules
from plumbline.registry import query, table
from plumbline.rendered import sql_text
from plumbline.sources import artefacts, benchmarks, bundle, xccdf
from plumbline.sources.tables import spread, stage_dir, staged


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# -- secrets --------------------------------------------------------------------------------------

#: text with a secret in [[...]], and what it becomes
_SECRETS = [
    ("username ops secret 9 $9$s[[k]]", "username ops secret 9 <redacted>"), ("username old password 7 08[[k]]", "username old password 7 <redacted>"), ("enable secret hush[[k]]", "enable secret <redacted>"), ("set password word[[k]] x", "set password <redacted> x"),
    ("snmp-server community c[[k]] RO", "snmp-server community <redacted> RO"), ("/snmp community add name=n[[k]] x=1", "/snmp community add name=<redacted> x=1"), ("name=m[[k]] is a community", "name=<redacted> is a community"),
    ("snmp-agent community read cipher c[[k]]", "snmp-agent community read cipher <redacted>"), ("hash $1$ab$x[[k]] end", "hash <redacted> end"), ("local-user x cipher y[[k]]", "local-user x cipher <redacted>"), ("tacacs key 7 z[[k]]", "tacacs key 7 <redacted>"),
    ("pre-shared-key p[[k]]", "pre-shared-key <redacted>"), ("authentication-key a[[k]] md5", "authentication-key <redacted> md5"), ("encrypted-password e[[k]];", "encrypted-password <redacted>"), ("plain-text-password t[[k]]", "plain-text-password <redacted>"),
    ("set passwd w[[k]]", "set passwd <redacted>"), ("set psksecret q[[k]]", "set psksecret <redacted>"), ("/ppp add password=p[[k]] x", "/ppp add password=<redacted> x"), ("add secret=s[[k]]", "add secret=<redacted>"), ("add psk=s[[k]]", "add psk=<redacted>"), ("add key=s[[k]]", "add key=<redacted>"),
    ("interface Vlan[[k]]", "interface Vlan[[k]]"), ("ntp server 10.0.0.[[k % 250]]", "ntp server 10.0.0.[[k % 250]]"),
]
_UNIONED = " UNION ALL ".join(f"SELECT c_custkey AS k, {n} AS form, {sql_text(after)} AS clean FROM (SELECT *, c_custkey AS k FROM customer)" for n, (_, after) in enumerate(_SECRETS))


@query(_UNIONED)
def redacted_lines(spark, sf_dir):
    """Every pattern of secrets over a line for each customer, and lines without one."""
    forms = F.array(*(F.struct(F.lit(n).alias("form"), F.expr(sql_text(before)).alias("text")) for n, (before, _) in enumerate(_SECRETS)))
    rows = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k").select("k", F.explode(forms).alias("f"))
    return rows.select("k", "f.form", scalars.redact(F.col("f.text")).alias("clean"))


@query("SELECT c_custkey AS k, 'note <redacted> and \"<redacted>\" of ' || c_mktsegment AS clean, 'x of ' || c_mktsegment AS short FROM customer")
def redacted_literals(spark, sf_dir):
    """A known secret of two letters or more goes wherever it stands, quotes aside."""
    rows = table(spark, sf_dir, "customer")
    secret = F.concat(F.lit("s3cr3t"), F.col("c_custkey").cast("string"))
    text = F.concat(F.lit("note "), secret, F.lit(' and "'), secret, F.lit('" of '), "c_mktsegment")
    return rows.select(F.col("c_custkey").alias("k"), scalars.redact_literal(text, F.concat(F.lit('"'), secret, F.lit('"'))).alias("clean"), scalars.redact_literal(F.concat(F.lit("x of "), "c_mktsegment"), F.lit("x")).alias("short"))


@query("SELECT 'd' || s_suppkey AS device_id, 'description ring <redacted> now' AS clean FROM supplier")
def scrubbed_lines(spark, sf_dir):
    """A device's own secrets go from its other lines too, known by their fingerprints only."""
    from plumbline.operators.documents import scrubbed, secrets_of

    rows = rendered.devices(spark, sf_dir, False).select(F.concat(F.lit("d"), F.col("k").cast("string")).alias("device_id"), F.concat(F.lit("hush"), F.col("k").cast("string")).alias("own"))
    facts = rows.select("device_id", scalars.credential_fingerprint(b"salt", F.col("own")).alias("secret"))
    lines = rows.select("device_id", F.concat(F.lit("description ring '"), "own", F.lit("', now")).alias("raw"))
    got = lines.join(secrets_of(facts), "device_id").select("device_id", scrubbed(F.col("raw"), F.col("secrets"), b"salt").alias("clean"))
    return got.withColumn("clean", F.translate("clean", "',", ""))


_HASHES = [("9", "x", "scrypt"), ("8", "x", "pbkdf2"), ("7", "x", "reversible"), ("5", "x", "md5"), ("4", "x", "sha256"), ("0", "x", "plaintext"), ("3", "$6$x", None), (None, "$1$x", "md5"), (None, "$5$x", "sha256"), (None, "$6$x", "sha512"), (None, "$2b$x", "bcrypt"), ("", "$9$x", "scrypt"), (None, "plain", None)]


@query("SELECT s_suppkey, CASE s_suppkey % 13 " + " ".join(f"WHEN {k} THEN {sql_text(a) if a else 'NULL'}" for k, (_, _, a) in enumerate(_HASHES)) + " END AS algorithm FROM supplier")
def hash_algorithms(spark, sf_dir):
    pick = lambda i: F.get(F.array(*(F.lit(h[i]).cast("string") for h in _HASHES)), (F.col("s_suppkey") % 13).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalars.hash_algorithm(pick(1), pick(0)).alias("algorithm"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'default' ELSE 'custom' END AS marker, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag FROM customer")
def markers_and_flags(spark, sf_dir):
    """Well-known communities whatever their case; truth words, null for others."""
    k = F.col("c_custkey")
    word = F.when(k % 4 == 0, '"Enabled"').when(k % 4 == 1, " off ").when(k % 4 == 2, "Y").otherwise("perhaps")
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.community_marker(F.when(k % 3 == 0, "PUBLIC").otherwise("own"), scalars.COMMUNITIES).alias("marker"), scalars.to_bool(word).alias("flag"))


_CUSTOMER = [("10.0.0.1 x", "an IPv4 address"), ("2001:db8::1", None), ("2001:db8:1:2:3:4", "an IPv6 address"), ("me@example.org", "an email address"), ("core.site.example.org", "a hostname"), ("$6$abc", "a credential hash"), ("abcdefghijklmnopqrstuvwx01", "a credential-shaped literal"), ("ntp server", None)]


@query("SELECT s_suppkey, CASE s_suppkey % 8 " + " ".join(f"WHEN {k} THEN {sql_text(a) if a else 'NULL'}" for k, (_, a) in enumerate(_CUSTOMER)) + " END AS kind FROM supplier")
def customer_data_kinds(spark, sf_dir):
    text = F.get(F.array(*(F.lit(t) for t, _ in _CUSTOMER)), (F.col("s_suppkey") % 8).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalars.customer_data(text).alias("kind"))


@query("SELECT 'ip address * * on ' || lower(c_mktsegment) || ' name=*' AS shape, count(*) AS n, min(c_custkey) AS first_line FROM customer GROUP BY 1")
def shape_families(spark, sf_dir):
    """Unread lines by shape: data varies, grammar words stay."""
    rows = table(spark, sf_dir, "customer").select(F.lit("d").alias("device_id"), F.lit("f").alias("file"), F.col("c_custkey").alias("line_no"), F.concat(F.lit("ip  address 10.0.0."), (F.col("c_custkey") % 250).cast("string"), F.lit(" 255.255.255.0 on "), "c_mktsegment", F.lit(" name=x"), F.col("c_custkey").cast("string")).alias("text"))
    return learning.families(rows).select("shape", "n", "first_line")


@query("SELECT o_orderkey, port, CASE form WHEN 0 THEN port = 22 WHEN 1 THEN port = o_orderkey % 100 WHEN 2 THEN port BETWEEN o_orderkey % 50 AND 80 ELSE false END AS hit FROM (SELECT o_orderkey, o_orderkey % 4 AS form FROM orders), (VALUES (22), (80)) x(port)")
def port_expressions(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, "eq ssh").when(k % 4 == 1, F.concat(F.lit("EQ "), (k % 100).cast("string"))).when(k % 4 == 2, F.concat((k % 50).cast("string"), F.lit("-www"))).otherwise("neq 22")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"), F.explode(F.array(F.lit(22), F.lit(80))).alias("port"))
    return rows.select("o_orderkey", "port", scalars.port_matches(F.col("t"), F.col("port")).alias("hit"))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'a pattern repeats a repetition' WHEN 2 THEN 'malformed pattern' WHEN 3 THEN 'a pattern holds an address' WHEN 4 THEN 'a pattern is too long' WHEN 6 THEN 'a pattern holds an address' END AS refused FROM part""")
def safe_patterns(spark, sf_dir):
    """Patterns that are long, malformed, repeat a repetition or show customer data are refused."""
    forms = ["concat('(a', k, '+)+')", r"concat('^x', k, ' (?P<value>\\S+)')", "concat('[', k)", "concat('10.0.0.', k % 200)", "repeat(concat('a', k), 401)", r"concat('^ntp ', k, ' \\S+$')", "concat('ntp 192.168.7.', k % 200)", "concat('word', k)"]
    pattern = "CASE p_partkey % 8 " + " ".join(f"WHEN {n} THEN {f.replace('k', 'p_partkey')}" for n, f in enumerate(forms)) + " END"
    told = packs.refusals(F.col("pattern"))
    kind = F.when(told.rlike("^a pattern holds"), "a pattern holds an address").otherwise(F.split_part(told, F.lit(":"), F.lit(1)))
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{pattern} AS pattern").select("p_partkey", kind.alias("refused"))


# -- learning -------------------------------------------------------------------------------------


@query("SELECT s_suppkey, 'ip ssh-server ssh server loghost log host port no-x no s' || (s_suppkey % 7) AS found FROM supplier")
def known_words(spark, sf_dir):
    """Words, the parts of hyphenated ones longer than a letter, and known halves of compounds."""
    text = F.concat(F.lit("IP ssh-server {loghost=5} port no-x 9 s"), (F.col("s_suppkey") % 7).cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(learning.words(text, ["log", "host", "server"]), " ").alias("found"))


@query("SELECT n_nationkey, 'w:' || w AS feature, 2.0::DOUBLE AS value FROM (SELECT n_nationkey, 'n' || n_nationkey AS w FROM nation) UNION ALL SELECT n_nationkey, 't:' || substr('#' || w || '#', i, 3), 0.5 FROM (SELECT n_nationkey, 'n' || n_nationkey AS w FROM nation), UNNEST(range(1, length(w) + 1)) AS u(i)")
def word_features(spark, sf_dir):
    """A word at its weight and its trigrams at a quarter of it."""
    word = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(learning.features(word, F.lit(2.0))).alias("f")).select("n_nationkey", "f.*")


#: shares of each benchmark item's words, as the query below ranks documents by them
_WORD = "unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9+-]*'))"
_RANKED = f"""WITH bw AS (SELECT item_id, w, count(*)::DOUBLE AS tf FROM (SELECT item_id, {_WORD} AS w FROM benchmark) GROUP BY ALL),
idf AS (SELECT w, ln(((SELECT count(*) FROM benchmark) + 1) / (count(*) + 1)) + 1 AS idf FROM bw GROUP BY w),
bv AS (SELECT item_id, w, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY item_id)) AS v FROM bw JOIN idf USING (w)),
dw AS (SELECT doc_id, w, count(*)::DOUBLE AS tf FROM (SELECT doc_id, {_WORD} AS w FROM documents) GROUP BY ALL),
dv AS (SELECT doc_id, w, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY doc_id)) AS v FROM dw JOIN idf USING (w)),
s AS (SELECT doc_id, item_id, round(sum(dv.v * bv.v), 6) AS score FROM dv JOIN bv USING (w) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS place FROM s)"""


def _words_of(df: DataFrame, ident: str) -> DataFrame:
    return df.select(ident, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z][a-z0-9+-]*)"), F.lit(1))).alias("feature"), F.lit(1.0).alias("value"))


@query(f"""{_RANKED}, e AS (SELECT doc_id, item_id, place, score, lead(score) OVER (PARTITION BY doc_id ORDER BY place) AS nxt, first_value(score) OVER (PARTITION BY doc_id ORDER BY place) AS best FROM r WHERE place <= 3)
SELECT doc_id, item_id, CAST(place AS INTEGER) AS place, round((0.15 + 0.7 * least(score / 0.6, 1.0) + 0.15 * coalesce((score - coalesce(nxt, 0)) / nullif(score, 0), 0)) * CASE WHEN place = 1 THEN 1.0 ELSE 0.75 * coalesce(score / nullif(best, 0), 0) END * CASE WHEN item_id % 2 = 0 THEN 1.0 ELSE 0.5 END, 4) AS confidence FROM e""")
def ranked_evidence(spark, sf_dir):
    """Three best matches with the confidence that score, lead and keywords support."""
    vocabulary = learning.vectors(_words_of(table(spark, sf_dir, "benchmark"), "item_id"), "item_id")
    ranked = learning.rank(_words_of(table(spark, sf_dir, "documents"), "doc_id"), vocabulary, "doc_id", "item_id", 3)
    sure = learning.evidence(ranked.withColumn("keyword", F.col("item_id") % 2 == 0), "doc_id")
    return sure.select("doc_id", "item_id", F.col("place").cast("int").alias("place"), F.round("confidence", 4).alias("confidence"))


#: line, field, value of lines that no grammar of an unknown vendor reads
_UNKNOWN = [
    ("sysname [[name]]", "device.hostname", "[[name]]"), ("telnet server enable", "mgmt.telnet_enabled", "true"), ("ssh server enable", "mgmt.ssh.enabled", "true"), ("ssh protocol version [[1 + k % 2]] only", "mgmt.ssh.version", "[[1 + k % 2]]"), ("idle-timeout [[k % 30]]", "mgmt.idle_timeout_min", "[[k % 30]]"),
    ("ntp-service unicast-server 10.0.0.[[n]]", "ntp.servers", "10.0.0.[[n]]"), ("info-center loghost 10.0.1.[[n]]", "logging.servers", "10.0.1.[[n]]"), ("snmp-agent community read hush[[k]]", "snmp.communities", "custom"), ("lldp enable", "services.discovery_protocols", "true"),
    ("undo telnet server enable", "mgmt.telnet_enabled", "false"), ("undo lldp enable", "services.discovery_protocols", "false"), ("no ip http server", "mgmt.http_enabled", "false"), ("http server [[CASE WHEN k % 2 = 0 THEN 'off' ELSE 'on' END]]", "mgmt.http_enabled", "[[CASE WHEN k % 2 = 0 THEN 'false' ELSE 'true' END]]"),
    ("/ip service set telnet disabled=[[CASE WHEN k % 2 = 0 THEN 'no' ELSE 'yes' END]]", "mgmt.telnet_enabled", "[[CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END]]"), ("snmp community add name=[[CASE WHEN k % 3 = 0 THEN 'public' ELSE 'hush' || k END]] x=1", "snmp.communities", "[[CASE WHEN k % 3 = 0 THEN 'default' ELSE 'custom' END]]"),
    ("snmp-agent community hush[[k]]", "snmp.communities", "custom"), ("ssh version [[1 + k % 2]] password hush7", "mgmt.ssh.version", "[[1 + k % 2]]"), ("password minimum length [[8 + k % 9]]", "aaa.password_policy.min_length", "[[8 + k % 9]]"),
    ("info-center loghost log.site.example.org", "logging.servers", "log.site.example.org"), ("ntp source-interface LoopBack[[k]]", "ntp.source", "LoopBack[[k]]"), ("snmp-agent community cipher hush[[k]]", None, None), ("strange words", None, None),
]


def _unknown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "array_join(array(" + ", ".join(sql_text(t) for t, _, _ in _UNKNOWN) + "), '\\n')"
    files = rendered.devices(spark, sf_dir, False).select(F.concat(F.lit("d"), F.col("k").cast("string")).alias("device_id"), F.lit("f").alias("file"), F.lit("config").alias("role"), F.expr(text).alias("text"))
    return bundle.lines(files)


_FIELDS = "SELECT 'd' || k AS device_id, f.n AS line_no, f.p AS path, f.v AS value FROM (SELECT k, unnest([" + ", ".join(f"{{'n': {n}, 'p': '{p}', 'v': {sql_text(v)}}}" for n, (_, p, v) in enumerate(_UNKNOWN, 1) if p) + f"]) AS f FROM {rendered.ONE})"


@query(_FIELDS)
def proposed_fields(spark, sf_dir):
    """Fields and values proposed for the lines of a vendor that no grammar reads."""
    return learning.propose(_unknown_lines(spark, sf_dir)).select("device_id", F.col("line_no").cast("long").alias("line_no"), "path", "value")


#: What a person says of the lines: as they mean, but for devices by seven, whose servers differ, and for the
#: last line, which only the person can read.
_LABELLED = f"SELECT device_id, line_no, path, CASE WHEN path = 'ntp.servers' AND CAST(substr(device_id, 2) AS BIGINT) % 7 = 0 THEN 'else' ELSE value END AS value, value AS said FROM ({_FIELDS}) UNION ALL SELECT 'd' || k, {len(_UNKNOWN)}, 'aaa.enabled', 'true', NULL FROM {rendered.ONE}"


@query(f"SELECT count(*) AS lines, count(said) AS proposed, count(said) AS right, count(*) FILTER (WHERE said = value) AS right_values, round_even(count(said) / count(*)::DOUBLE, 4)::DOUBLE AS accuracy, round_even(count(*) FILTER (WHERE said = value) / count(*)::DOUBLE, 4)::DOUBLE AS value_agreement FROM ({_LABELLED})")
def held_out_evaluation(spark, sf_dir):
    """Proposals against the truth of each line, which is told without them."""
    base = rendered.devices(spark, sf_dir, False)
    told = [(n, p, v) for n, (_, p, v) in enumerate(_UNKNOWN, 1) if p]
    rows = F.array(*(F.struct(F.lit(n).alias("line_no"), F.lit(p).alias("path"), F.expr(sql_text(v)).alias("value")) for n, p, v in told), F.struct(F.lit(len(_UNKNOWN)).alias("line_no"), F.lit("aaa.enabled").alias("path"), F.lit("true").alias("value")))
    truth = base.select("k", F.concat(F.lit("d"), F.col("k").cast("string")).alias("device_id"), F.lit("f").alias("file"), F.explode(rows).alias("r")).select("k", "device_id", "file", "r.*")
    truth = truth.withColumn("value", F.when((F.col("path") == "ntp.servers") & (F.col("k") % 7 == 0), "else").otherwise(F.col("value")))
    return learning.held_out(learning.propose(_unknown_lines(spark, sf_dir)), truth).select("lines", "proposed", "right", "right_values", "accuracy", "value_agreement")


@query(f"""WITH t AS (SELECT * FROM (VALUES {", ".join(f"({n}, '{p}', '{t}', '{m}')" for n, p, t, m in [
    (2, "mgmt.telnet_enabled", "to_bool", "^telnet\\s+server\\s+(?P<value>enable|disable)$"), (10, "mgmt.telnet_enabled", "negated_presence", "^undo\\s+telnet\\s+server\\s+enable$"),
    (6, "ntp.servers", "collect", "^ntp-service\\s+unicast-server\\s+(?P<value>[0-9A-Fa-f:./]+)$"), (14, "mgmt.telnet_enabled", "invert_yes_no", "^/ip\\s+service\\s+set\\s+telnet\\s+disabled=(?P<value>yes|no)$"),
    (15, "snmp.communities", "collect_redacted", "^snmp\\s+community\\s+add\\s+name=(?P<value>[^\\s;]+)\\s+x=\\S+$"), (17, "mgmt.ssh.version", "to_int", "^ssh\\s+version\\s+(?P<value>\\d+)\\s+password\\s+\\S+$"),
    (20, "ntp.source", "identity", "^ntp\\s+source-interface\\s+(?P<value>[^\\s;]+)$")])}) x(line_no, path, transform, match))
SELECT path, transform, match, count(*) AS devices FROM t, supplier GROUP BY ALL""")
def synthesised_rules(spark, sf_dir):
    """The rules that proposals become: polarity, pairs of truth words, open data, no secrets."""
    found = learning.propose(_unknown_lines(spark, sf_dir)).where(F.col("line_no").isin(2, 6, 10, 14, 15, 17, 20))
    return found.groupBy("path", "transform", "match").agg(F.count("*").alias("devices"))


@query("SELECT 'd' || s_suppkey AS device_id, CAST(n AS BIGINT) AS line_no, CASE n WHEN 2 THEN 'true' END AS value, n = 2 AS applies FROM supplier, (VALUES (2), (3)) x(n)")
def mapping_preview(spark, sf_dir):
    """Where a mapping matches: it applies to unread lines whose value its transform can make."""
    lines = _unknown_lines(spark, sf_dir)
    facts = lines.where("line_no = 3").select("device_id", "file", "line_no", F.lit(True).alias("claim"))
    mapping = packs.Mapping("mgmt.telnet_enabled", r"^(?:telnet server|ssh server) (?P<value>\w+)", "to_bool")
    got = learning.preview(mapping, lines, facts)
    return got.select("device_id", F.col("line_no").cast("long").alias("line_no"), F.when(F.col("applies"), F.col("value")).alias("value"), "applies")


@query("SELECT * FROM (VALUES ('^telnet', 3), ('^ssh server', 3)) x(match, tier)")
def confirmed_mappings(spark, sf_dir):
    """Mappings as a person confirms them; the same pattern replaces, a withdrawn one goes, one that reads no
    unread line is refused."""
    lines = _unknown_lines(spark, sf_dir)
    facts = lines.limit(0).select("device_id", "file", "line_no", F.lit(True).alias("claim"))
    held: list = []
    for match in ("^telnet", "^ssh server", "^telnet", "^lldp", "^never there"):
        try:
            held = learning.confirm(held, packs.Mapping("aaa.enabled", match, "presence"), lines, facts)
        except packs.PackError:
            continue
    return _values(spark, [(m.match, m.tier) for m in learning.withdraw(held, "^lldp")], "match string, tier int")


@query(r"""WITH heads AS (SELECT p_brand AS pack, replace(p_name, ' ', '\s+') AS head, min(p_partkey) AS place FROM part GROUP BY ALL), five AS (SELECT * FROM heads QUALIFY row_number() OVER (PARTITION BY pack ORDER BY place) <= 5)
SELECT pack, '^\s*' || head || '\b' AS pattern, round(least(0.9, 1 / count(*) OVER (PARTITION BY pack) + 0.15), 2) AS confidence FROM five""")
def pack_fingerprint(spark, sf_dir):
    """The words that begin the patterns of each taught vendor, five at most, weighed evenly."""
    match = F.concat(F.lit("^"), F.regexp_replace("p_name", " ", r"\\s+"), F.lit(r" (?P<value>\S+)"))
    return learning.fingerprints(table(spark, sf_dir, "part").select(F.col("p_brand").alias("pack"), F.col("p_partkey").alias("place"), match.alias("match")))


@query(r"""WITH f AS (SELECT DISTINCT p_partkey // 5 AS k FROM part) SELECT 'p' || k || '.json' AS file, CASE WHEN k % 7 = 3 THEN NULL ELSE sha256('{"fingerprint":[],"id":"pack' || k || '","mappings":[{"confidence":"0.8765","match":"^feature' || k || '$","path":"aaa.enabled","tier":2,"transform":"presence","values":{},"within":""}],"os":"","vendor":"v"}') END AS digest,
k % 2 = 0 AND k % 7 <> 3 AND k < 200 AS admitted, CASE WHEN k % 7 = 3 THEN 'a pack lacks' WHEN k % 2 = 0 AND k < 200 THEN NULL ELSE 'isn''t trusted' END AS problem FROM f""")
def pack_trust(spark, sf_dir):
    """Packs of a registry, one per five parts: digests of what they say, those trusted, and what is wrong with the rest."""
    trusted = {packs.Pack(f"pack{k}", "v", None, (packs.Mapping("aaa.enabled", f"^feature{k}$", "presence", 2, 0.87654),)).digest() for k in range(0, 200, 2)}
    body = """concat('{"id": "pack', k, '", ', IF(k % 7 = 3, '', '"vendor": "v", '), '"mappings": [{"ir_path": "aaa.enabled", "match": "^feature', k, '$", "transform": "presence", "tier_learned": 2, "confidence": 0.87654}]}')"""
    files = table(spark, sf_dir, "part").selectExpr("p_partkey div 5 AS k").distinct().selectExpr("concat('p', k, '.json') AS file", f"{body} AS text")
    got = packs.checked(files, trusted)
    return got.select("file", "digest", "admitted", F.when(F.col("problem").rlike("lacks"), "a pack lacks").when(F.col("problem").isNotNull(), F.regexp_extract("problem", "isn't trusted", 0)).alias("problem"))


# -- ledger ---------------------------------------------------------------------------------------

_LEAF = "'{\"evidence\":[],\"missing_paths\":[],\"rule_id\":\"CIS-NET-1.1.2\",\"severity\":\"high\",\"state\":\"asserted\",\"verdict\":\"pass\"}'"


@query(f"SELECT 'd' || s_suppkey AS device_id, sha256('\\x00'::BLOB || encode({_LEAF})) AS leaf FROM supplier WHERE s_suppkey % 6 IN (2, 3)")
def ledger_leaves(spark, sf_dir):
    """What the ledger commits to for a finding, in canonical text."""
    from plumbline.catalog_devices import fleet

    found = fleet(spark, sf_dir).findings.where("rule_id = 'CIS-NET-1.1.2' and verdict = 'pass'").join(fleet(spark, sf_dir).devices.where("vendor in ('juniper', 'fortinet')").select("device_id"), "device_id")
    return ledger.leaf_material(found).select("device_id", "leaf")


def _level(l: str) -> str:
    return f"list_transform(range(0, (len({l}) + 1) // 2), lambda i: CASE WHEN 2 * i + 2 <= len({l}) THEN sha256('\\x01'::BLOB || unhex({l}[2 * i + 1]) || unhex({l}[2 * i + 2])) ELSE {l}[2 * i + 1] END)"


@query(f"""WITH l0 AS (SELECT l_orderkey, list(sha256('\\x00'::BLOB || encode(l_orderkey || ':' || l_linenumber || ':' || l_partkey)) ORDER BY l_linenumber, l_partkey) AS l FROM lineitem GROUP BY l_orderkey),
l1 AS (SELECT l_orderkey, CASE WHEN len(l) > 1 THEN {_level('l')} ELSE l END AS l FROM l0), l2 AS (SELECT l_orderkey, CASE WHEN len(l) > 1 THEN {_level('l')} ELSE l END AS l FROM l1), l3 AS (SELECT l_orderkey, CASE WHEN len(l) > 1 THEN {_level('l')} ELSE l END AS l FROM l2),
l4 AS (SELECT l_orderkey, CASE WHEN len(l) > 1 THEN {_level('l')} ELSE l END AS l FROM l3), l5 AS (SELECT l_orderkey, CASE WHEN len(l) > 1 THEN {_level('l')} ELSE l END AS l FROM l4) SELECT l_orderkey, l[1] AS root, len(l) AS left_over FROM l5""")
def ledger_roots(spark, sf_dir):
    """Roots over an order's lines: pairs hash together, an odd one moves up; nothing is left over."""
    return _order_trees(spark, sf_dir).select("l_orderkey", relational.merkle_root(F.col("leaves")).alias("root"), F.lit(1).cast("long").alias("left_over"))


_EVENT = "'{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\",\"none\":null,\"who\":[{\"a\":1,\"b\":' || user_id || '}]}'"


@query(f"SELECT event_id, {_EVENT} AS body FROM events")
def canonical_text(spark, sf_dir):
    """Keys in order at every depth, nulls written, no spaces."""
    who = F.array(F.struct(F.col("user_id").alias("b"), F.lit(1).alias("a")))
    rows = table(spark, sf_dir, "events").select("event_id", F.struct(who.alias("who"), F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("none"), F.col("event_id").alias("id")).alias("x"))
    return rows.select("event_id", ledger.canonical_json(F.col("x"), rows.schema["x"].dataType).alias("body"))


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """A ledger of one entry per nation, written in two batches."""
    path = stage_dir(spark, "ledger")
    n = table(spark, sf_dir, "nation").count()
    report = lambda k: {"timestamp": "t", "report_id": f"r{k}", "device_id": f"d{k}", "merkle_root": "0", "rule_set_digest": "x", "ir_schema_version": "1.0.0"}
    ledger.record(spark, path, [report(k) for k in range(10)])
    ledger.record(spark, path, [report(k) for k in range(10, n)])
    return ledger.read(spark, path), n


@query("SELECT * FROM (VALUES ('as written', NULL, NULL), ('rewritten', 5::BIGINT, 'the chain is broken'), ('lost', 8::BIGINT, 'entry 7 is missing'), ('repeated', 3::BIGINT, 'the entry is there more than once')) x(ledger, seq, problem)")
def ledger_verification(spark, sf_dir):
    """A ledger in two batches verifies; a rewritten, a lost and a repeated entry are each told."""
    good, _ = _chain(spark, sf_dir)
    bad = {"as written": good, "rewritten": good.withColumn("merkle_root", F.when(F.col("seq") == 4, "1").otherwise(F.col("merkle_root"))), "lost": good.where("seq <> 7"), "repeated": good.union(good.where("seq = 3"))}
    names = _values(spark, [(k,) for k in bad], "ledger string")
    found = None
    for name, entries in bad.items():
        one = ledger.verify(entries).select(F.lit(name).alias("ledger"), "seq", "problem")
        found = one if found is None else found.unionByName(one)
    return names.join(found, "ledger", "left")


_SIGNED_CASES = "CASE WHEN s_suppkey % 5 = 0 THEN 'unsigned' WHEN s_suppkey % 7 = 0 THEN 'signed by a key that isn''t known' WHEN s_suppkey % 3 = 0 THEN 'the signature doesn''t verify' END"


@query(f"SELECT * FROM (SELECT CAST(s_suppkey AS BIGINT) AS seq, {_SIGNED_CASES} AS problem FROM supplier) WHERE problem IS NOT NULL")
def ledger_signatures(spark, sf_dir):
    """An entry per supplier, signed: some are altered afterwards, some signed by a stranger, some not at all."""
    own, stranger = ed25519.SigningKey(b"ours".ljust(32)), ed25519.SigningKey(b"theirs".ljust(32))  # keys of this example only

    def signatures(texts: pd.Series, strange: pd.Series) -> pd.Series:
        out = pd.Series("", index=texts.index, dtype=object)
        for key, its in ((own, ~strange & texts.notna()), (stranger, strange & texts.notna())):
            out[its] = [s.hex() for s in key.sign_all([t.encode() for t in texts[its]])]
        return out

    sign = F.pandas_udf(signatures, "string")
    seq, strange, signs = F.col("s_suppkey").cast("long"), F.coalesce(F.col("seq") % 7 == 0, F.lit(False)), F.coalesce(F.col("seq") % 5 != 0, F.lit(True))
    fixed = {"timestamp": "t", "merkle_root": "0", "prev_entry_hash": ledger.GENESIS, "rule_set_digest": "x", "ir_schema_version": "1.0.0", "canonicalisation": "jcs-1"}
    rows = spread(table(spark, sf_dir, "supplier").select(seq.alias("seq"), F.col("s_name").alias("device_id")), "seq").select("seq", "device_id", F.concat(F.lit("r"), F.col("seq").cast("string")).alias("report_id"), *(F.lit(v).alias(k) for k, v in fixed.items()))
    signed = rows.withColumn("signature", sign(F.when(signs, ledger.entry_text()), strange)).withColumn("key_id", F.when(strange, stranger.key_id).otherwise(own.key_id))
    altered = signed.withColumn("device_id", F.when(F.col("seq") % 3 == 0, F.concat(F.coalesce("device_id", F.lit("")), F.lit("!"))).otherwise(F.col("device_id")))
    return ledger.unsigned(altered, {own.key_id: own.public})


def _order_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = scalars.leaf_hash(F.concat_ws(":", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", leaf.alias("h")))), lambda x: x["h"]).alias("leaves"))


@query("""WITH leaves AS (SELECT l_orderkey AS o, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, sha256('\\x00'::BLOB || encode(l_orderkey || ':' || l_linenumber || ':' || l_partkey)) AS leaf FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)),
steps AS (SELECT o, k, count(*) FILTER (xor(k >> i, 1) < ((n - 1) >> i) + 1 AND ((n - 1) >> i) > 0) AS steps FROM leaves, range(40) x(i) GROUP BY ALL)
SELECT a.o AS l_orderkey, a.k AS place, a.leaf, steps, b.leaf AS beside, true AS included, false AS forged FROM leaves a JOIN steps s ON s.o = a.o AND s.k = a.k LEFT JOIN leaves b ON b.o = a.o AND b.k = xor(a.k, 1)""")
def ledger_inclusion(spark, sf_dir):
    """Every line of every order is proved by its siblings up to the order's root, and no other line is."""
    made = ledger.proofs(_order_trees(spark, sf_dir), ["l_orderkey"])
    forged = F.sha2(F.concat("leaf", F.lit("x")), 256)
    beside = F.when((F.size("proof") > 0) & (F.col("at").bitwiseXOR(F.lit(1)) < F.col("n")), F.get("proof", F.lit(0))["hash"])
    sizes = _order_trees(spark, sf_dir).select("l_orderkey", F.size("leaves").alias("n"))
    rows = made.join(sizes, "l_orderkey")
    return rows.select(
        "l_orderkey", F.col("at").cast("long").alias("place"), "leaf", F.size("proof").cast("long").alias("steps"), beside.alias("beside"),
        ledger.proves(F.col("leaf"), F.col("proof"), F.col("root")).alias("included"), ledger.proves(forged, F.col("proof"), F.col("root")).alias("forged"),
    )


@query("SELECT 'd' || s_suppkey AS device_id, true AS proved, true AS same_root, false AS swapped FROM supplier")
def finding_inclusion(spark, sf_dir):
    """Every finding of every device is proved to the device's root; with another finding's siblings it isn't."""
    from plumbline.catalog_devices import fleet

    leaves = ledger.leaf_material(fleet(spark, sf_dir).findings.where("verdict <> 'not_applicable'"))
    made = ledger.finding_proofs(leaves)
    roots = ledger.roots(leaves)
    rows = made.join(roots, "device_id").withColumn("swapped", ledger.proves(F.sha2("leaf", 256), F.col("proof"), F.col("root")))
    return rows.groupBy("device_id").agg(F.bool_and(ledger.proves(F.col("leaf"), F.col("proof"), F.col("merkle_root"))).alias("proved"), F.bool_and(F.col("root") == F.col("merkle_root")).alias("same_root"), F.bool_or("swapped").alias("swapped"))


# -- benchmarks and sources -----------------------------------------------------------------------


#: A benchmark of every fifty parts: in some files names have a prefix, others have a document type or never end.
_PARTS = "SELECT p_partkey AS k, p_partkey // 50 AS f, p_name FROM part"
_CONTROLS = f"""(SELECT 'b' || f || '.xml' AS file, k, p_name, ['critical', 'medium', 'low', 'info'][k % 4 + 1] AS severity FROM ({_PARTS}) WHERE f % 7 NOT IN (3, 5))"""


def _benchmark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_partkey div 50 AS f", "p_name", "IF(p_partkey div 50 % 2 = 1, 'x:', '') AS x")
    group = F.expr("""concat('<', x, 'Group id="V-', k, '"><', x, 'Rule id="SV-', k, '" severity="', element_at(array('high', 'MEDIUM', 'low', 'none'), int(k % 4 + 1)), '"><', x, 'version>PART-', k, '</', x, 'version><', x, 'title>', p_name, '</', x, 'title><', x, 'description>&lt;VulnDiscussion&gt;why ', k, '&lt;/VulnDiscussion&gt;</', x,
 'description><', x, 'ident system="http://iase.disa.mil/cci">CCI-', lpad(k, 6, '0'), '</', x, 'ident><', x, 'fixtext>', IF(k % 9 = 0, '', concat('mend <b>', k, '</b>')), '</', x, 'fixtext></', x, 'Rule></', x, 'Group>')""")
    made = rows.withColumn("g", group).groupBy("f", "x").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "g"))), lambda r: r["g"]), "").alias("groups"))  # fifty
    return made.selectExpr("concat('b', f, '.xml') AS file", """concat('<?xml version="1.0"?>', IF(f % 7 = 3, '<!DOCTYPE x>', ''), '<', x, 'Benchmark xmlns', IF(x = '', '', ':x'), '="http://checklists.nist.gov/xccdf/1.1">', groups, IF(f % 7 = 5, '', concat('</', x, 'Benchmark>'))) AS text""")


@query(f"SELECT file, 'V-' || k AS vuln_id, 'PART-' || k AS stig_id, p_name AS title, severity, 'CCI-' || lpad(CAST(k AS VARCHAR), 6, '0') AS cci, 'why ' || k AS discussion, CASE WHEN k % 9 = 0 THEN '' ELSE 'mend ' || k END AS fix FROM {_CONTROLS}")
def benchmark_controls(spark, sf_dir):
    """The controls of many benchmarks, whatever their namespaces."""
    df = benchmarks.parse(_benchmark_files(spark, sf_dir)).where("error is null")
    return df.select("file", "vuln_id", "stig_id", "title", "severity", F.get("ccis", F.lit(0)).alias("cci"), "discussion", "fix")


@query(f"SELECT 'b' || f || '.xml' AS file, CASE WHEN f % 7 = 3 THEN 'a document type is refused' ELSE 'not well-formed' END AS error FROM ({_PARTS}) WHERE f % 7 IN (3, 5) GROUP BY f")
def benchmark_failures(spark, sf_dir):
    """A benchmark that can't be read is told, and the others are read."""
    return benchmarks.parse(_benchmark_files(spark, sf_dir)).where("error is not null").select("file", "error")


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings of the first thousand numbers, by either id: those by fours come first, then by threes, then by twos."""
    made = [{"assert": "mgmt.telnet_enabled == false", "vuln_id": f"v-{k}", "remediation_from": "CIS-NET-1.1.1"} for k in range(0, 1000, 4)]
    made += [{"assert": "mgmt.http_enabled == false", "stig_id": f"Part-{k}", "frameworks": ["OWN:1"], "severity": "LOW"} for k in range(0, 1000, 3)]
    made += [{"assert": "snmp.version == 3", "vuln_id": f"V-{k}", "stig_id": f"PART-{k}", "remediation": {"own": [f"do {k}"]}} for k in range(0, 1000, 2)]
    return benchmarks.bind(benchmarks.parse(_benchmark_files(spark, sf_dir)), [xccdf.Binding.of(b) for b in made], rules.SHIPPED)


_WAY = "CASE WHEN k >= 1000 THEN 0 WHEN k % 4 = 0 THEN 1 WHEN k % 3 = 0 THEN 2 WHEN k % 2 = 0 THEN 3 ELSE 0 END"


@query(f"""SELECT file, stig_id, way > 0 AS bound, CASE WHEN way > 0 THEN stig_id END AS rule, ['mgmt.telnet_enabled == false', 'mgmt.http_enabled == false', 'snmp.version == 3'][way] AS assertion, CASE way WHEN 2 THEN 'low' WHEN 0 THEN NULL ELSE severity END AS rule_severity,
CASE way WHEN 1 THEN 'configure' WHEN 2 THEN CASE WHEN k % 9 = 0 THEN 'See the benchmark fix text.' ELSE 'mend ' || k END WHEN 3 THEN 'do ' || k END AS first_command,
CASE WHEN way > 0 THEN 'STIG:' || stig_id || ',STIG-VULN:V-' || k || ',CCI:CCI-' || lpad(CAST(k AS VARCHAR), 6, '0') || CASE way WHEN 2 THEN ',OWN:1' ELSE '' END END AS frameworks
FROM (SELECT *, 'PART-' || k AS stig_id, {_WAY} AS way FROM {_CONTROLS})""")
def benchmark_bindings(spark, sf_dir):
    """The first binding of a control counts, by either id whatever the case; the rest stays manual."""
    steps = lambda vendor: F.get(F.filter("fixes", lambda x: x["vendor"] == vendor), F.lit(0))["steps"]
    told = F.coalesce(*map(steps, ("panos", "manual", "own")))
    return _bound(spark, sf_dir).select("file", "stig_id", "bound", "rule", "assertion", "rule_severity", F.get(told, F.lit(0)).alias("first_command"), F.array_join("frameworks", ",").alias("frameworks"))


@query(f"SELECT file, severity, count(*) AS controls, count(*) FILTER (WHERE {_WAY} > 0) AS checked FROM {_CONTROLS} GROUP BY ALL")
def benchmark_counts(spark, sf_dir):
    return benchmarks.counts(_bound(spark, sf_dir))


@query("SELECT p_partkey, left('A-b-' || p_partkey || '-' || replace(p_name, ' ', '-') || '-' || repeat('x', 60), 64) AS clean FROM part")
def benchmark_ids(spark, sf_dir):
    """Ids keep letters, digits, dots and dashes, 64 at most."""
    raw = F.concat(F.lit("/ A b/"), F.col("p_partkey").cast("string"), F.lit(" + "), "p_name", F.lit("//"), F.repeat(F.lit("x"), 60), F.lit("!"))
    return table(spark, sf_dir, "part").select("p_partkey", benchmarks.clean_id(raw).alias("clean"))


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """Files of devices on disk: a folder of each supplier with a configuration, show output and a picture."""
    path = stage_dir(spark, "bundle+x")
    rows = rendered.devices(spark, sf_dir, False)
    file = lambda name, text: F.struct(F.lit(name).alias("name"), F.expr(text).alias("text"))
    made = rows.select("k", F.explode(F.array(file("running.cfg", "'hostname ' || name || '\\nend\\n'"), file("show-version.txt", "'Version 1'"), file("logo.png", "'x'"))).alias("f"))
    text = F.when(F.col("k") % 2 == 0, F.concat(F.lit("\ufeff"), "f.text")).otherwise(F.col("f.text"))
    artefacts.write_folders(made.select(F.concat(F.lit("dev"), F.col("k").cast("string")).alias("folder"), "f.name", text.alias("value")), path)
    return path


@query("""SELECT 'dev' || s_suppkey AS device_id, 'running.cfg' AS file, 'config' AS role, 'hostname ' || s_name || chr(10) || 'end' || chr(10) AS text FROM supplier UNION ALL SELECT 'dev' || s_suppkey, 'show-version.txt', 'show_output', 'Version 1' FROM supplier""")
def bundle_folder(spark, sf_dir):
    """A folder of devices: suffixes, roles by name, byte order marks."""
    return bundle.load(spark, _folder(spark, sf_dir))


@query("""SELECT 'd' || s_suppkey AS device_id, 'd' || s_suppkey || suffix AS file, CASE WHEN suffix = '.cfg' THEN 'config' ELSE 'show_output' END AS role, 'naïve' AS text FROM supplier, (VALUES ('.cfg'), ('.show-version.txt')) x(suffix)""")
def bundle_loose_files(spark, sf_dir):
    """Loose files group by their name up to the first dot; text is UTF-8, or Latin-1 where it isn't."""
    rows = rendered.devices(spark, sf_dir, False).select("k", F.explode(F.array(F.lit(".cfg"), F.lit(".show-version.txt"), F.lit(".exe"))).alias("s"))
    content = F.when(F.col("k") % 2 == 0, F.encode(F.lit("naïve"), "UTF-8")).otherwise(F.encode(F.lit("naïve"), "ISO-8859-1"))
    return bundle.source_files(rows.select(F.concat(F.lit("d"), F.col("k").cast("string"), "s").alias("path"), content.alias("content")))


@query("SELECT 'device' AS device_id, 'core.cfg' AS file, 'config' AS role UNION ALL SELECT 'device', 'core.inventory-' || s_suppkey || '.txt', 'show_output' FROM supplier")
def bundle_single_device(spark, sf_dir):
    """A folder with one configuration and no folders is one device, however many outputs lie beside it."""
    rows = table(spark, sf_dir, "supplier")
    names = rows.select(F.concat(F.lit("core.inventory-"), F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("path")).unionByName(rows.agg(F.lit("core.cfg").alias("path")))
    return bundle.source_files(names.withColumn("content", F.encode("path", "UTF-8"))).select("device_id", "file", "role")


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive per supplier: two devices each; some climb out, start at the root, inflate too far or are damaged."""

    def packed(batches):  # noqa: ANN001, ANN202
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            out = []
            for k in batch["k"]:
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(f"a{k}/a.cfg", f"hostname a{k}")
                    z.writestr({1: "/etc/x.cfg", 2: "a/../../x.cfg"}.get(k % 7, f"b{k}.show-version.txt"), "0" * 5_000_000 if k % 7 == 3 else f"Version {k}")
                    z.writestr(f"b{k}/logo.png", "x")
                content = held.getvalue()
                out.append((f"z{k}.zip", content[:40] if k % 7 == 4 else content))
            yield pd.DataFrame(out, columns=["archive", "content"])

    return spread(table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k"), "k").mapInPandas(packed, "archive string, content binary")


@query("SELECT 'z' || s_suppkey || '.zip' AS archive, 'a' || s_suppkey AS device_id, 'a.cfg' AS file, 'config' AS role, 'hostname a' || s_suppkey AS text FROM supplier WHERE s_suppkey % 7 NOT IN (1, 2, 3, 4) UNION ALL SELECT 'z' || s_suppkey || '.zip', 'b' || s_suppkey, 'b' || s_suppkey || '.show-version.txt', 'show_output', 'Version ' || s_suppkey FROM supplier WHERE s_suppkey % 7 NOT IN (1, 2, 3, 4)")
def bundle_archive(spark, sf_dir):
    """Zip archives are checked, unpacked and read by executors."""
    return bundle.bundles(_archives(spark, sf_dir))


@query("SELECT 'z' || s_suppkey || '.zip' AS archive, CASE s_suppkey % 7 WHEN 3 THEN 'inflates' WHEN 4 THEN 'damaged' ELSE 'unsafe path' END AS refused FROM supplier WHERE s_suppkey % 7 IN (1, 2, 3, 4)")
def unsafe_archives(spark, sf_dir):
    """Archives that climb out, start at the root, inflate too far or are damaged are refused, and nothing of them is read."""
    told = F.col("error")
    why = F.when(F.contains(told, F.lit("inflates")), "inflates").when(F.contains(told, F.lit("unsafe path")), "unsafe path").otherwise("damaged")
    made = bundle.unpacked(_archives(spark, sf_dir))
    refused = made.groupBy("archive").agg(F.max("error").alias("error"), F.count("path").alias("read")).where("error is not null")
    return refused.select("archive", F.when(F.col("read") == 0, why).alias("refused"))


@query("SELECT doc_id, CAST(len(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E]')) - CASE WHEN regexp_matches(text, '[\\n\\r\\x0B\\x0C\\x1C-\\x1E]$') OR text = '' THEN 1 ELSE 0 END AS BIGINT) AS n FROM (SELECT doc_id, replace(text, chr(10), CASE WHEN doc_id % 2 = 0 THEN chr(13) || chr(10) ELSE chr(11) END) AS text FROM documents) WHERE text IS NOT NULL AND text <> ''")
def line_ends(spark, sf_dir):
    """Lines end as a text reader ends them, whatever sign ends them; an ending end starts no line."""
    text = F.expr("replace(text, '\\n', CASE WHEN doc_id % 2 = 0 THEN '\\r\\n' ELSE '\\u000B' END)")
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("device_id"), F.lit("f").alias("file"), F.lit("config").alias("role"), text.alias("text"))
    return bundle.lines(files).groupBy(F.col("device_id").alias("doc_id")).agg(F.count("*").alias("n"))


# -- labels, written audits -----------------------------------------------------------------------


_LABELLED = "(SELECT 'l' || s_suppkey || '.json' AS file, s_suppkey AS k FROM supplier)"


@query(f"""SELECT file, NULL AS device_id, NULL AS name, NULL AS said, NULL AS line, 'a label needs a config_id' AS error FROM {_LABELLED} WHERE k % 11 IN (3, 4)
UNION ALL SELECT file, 'd' || k, 'mgmt.telnet_enabled', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END, 3, NULL FROM {_LABELLED} WHERE k % 11 NOT IN (3, 4)
UNION ALL SELECT file, 'd' || k, 'ntp.servers', '10.0.0.1,10.0.0.' || k, NULL, NULL FROM {_LABELLED} WHERE k % 11 NOT IN (3, 4)
UNION ALL SELECT file, 'd' || k, 'mgmt.idle_timeout_min', CASE WHEN k % 5 <> 0 THEN CAST(k AS VARCHAR) END, NULL, CASE WHEN k % 5 = 1 THEN 'mgmt.idle_timeout_min needs a value' END FROM {_LABELLED} WHERE k % 11 NOT IN (3, 4) AND k % 5 <> 1
UNION ALL SELECT file, 'd' || k, 'mgmt.idle_timeout_min', NULL, 9, 'mgmt.idle_timeout_min needs a value' FROM {_LABELLED} WHERE k % 11 NOT IN (3, 4) AND k % 5 = 1
UNION ALL SELECT file, 'd' || k, 'CIS-NET-1.1.1', CASE WHEN k % 7 <> 2 THEN 'fail' END, NULL, CASE WHEN k % 7 = 2 THEN 'CIS-NET-1.1.1 can''t be failed' END FROM {_LABELLED} WHERE k % 11 NOT IN (3, 4)""")
def label_documents(spark, sf_dir):
    """Label files of all suppliers: values of any kind as text; what can't be used is told, and the rest counts."""
    from plumbline.operators import validation

    timeout = "CASE k % 5 WHEN 0 THEN '{\"value\": null}' WHEN 1 THEN '{\"line\": 9}' ELSE concat('{\"value\": ', k, '}') END"
    body = f"""concat('{{"config_id": "d', k, '", "ir_facts": {{"mgmt.telnet_enabled": {{"value": ', IF(k % 2 = 0, 'true', 'false'), ', "line": 3}}, "ntp.servers": {{"value": ["10.0.0.1", "10.0.0.', k, '"]}}, "mgmt.idle_timeout_min": ', {timeout}, '}}, "expected_verdicts": {{"CIS-NET-1.1.1": "', IF(k % 7 = 2, 'failed', 'fail'), '"}}}}')"""
    files = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k").selectExpr("concat('l', k, '.json') AS file", f"CASE k % 11 WHEN 3 THEN '{{\"ir_facts\": {{}}}}' WHEN 4 THEN 'no json' ELSE {body} END AS text")
    return validation.labels(files).select("file", "device_id", "name", F.col("value").alias("said"), "line", "error")


@query("SELECT 'd' || s_suppkey AS device_id, s_suppkey % 2 = 0 AS rules_changed FROM supplier")
def written_audits(spark, sf_dir):
    """Audits that were written as JSON and read again; half of them were made with other rules."""
    from plumbline.catalog_devices import fleet

    rows = staged(fleet(spark, sf_dir).reports(), "audits")  # they are written twice
    path = stage_dir(spark, "written")
    rows.write.json(f"{path}/a")
    other = F.when(F.expr("substring(device_id, 2)").cast("long") % 2 == 0, "other").otherwise(F.col("rule_set"))
    rows.withColumn("rule_set", other).write.json(f"{path}/b")
    a, b = drift.written_verdicts(spark, f"{path}/a"), drift.written_verdicts(spark, f"{path}/b")
    drift.same_devices(a, b)
    changed = drift.rules_changed(a, b).withColumn("rules_changed", F.lit(True))
    return a.select("device_id").distinct().join(changed, "device_id", "left").select("device_id", F.coalesce("rules_changed", F.lit(False)).alias("rules_changed"))


@query("SELECT 'd' || s_suppkey AS device_id, 'ntp.authenticated' AS ir_path, CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END AS before, NULL AS after FROM supplier UNION ALL SELECT 'd' || s_suppkey, 'ntp.servers', '10.0.0.1,10.0.0.2', '10.0.0.1' FROM supplier")
def written_documents(spark, sf_dir):
    """Facts of two tables of documents, path by path."""
    from plumbline.catalog_devices import fleet

    kind = fleet(spark, sf_dir).documents.schema
    base = rendered.devices(spark, sf_dir, False).select(F.concat(F.lit("d"), F.col("k").cast("string")).alias("device_id"), "k")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in kind if f.name not in ("device_id", "ntp")]
    ntp = lambda servers, auth: F.struct(servers.alias("servers"), auth.alias("authenticated"), F.lit(None).cast("string").alias("source"))
    a = base.select("device_id", *empty, ntp(F.array(F.lit("10.0.0.1"), F.lit("10.0.0.2")), F.col("k") % 2 == 0).alias("ntp"))
    b = base.select("device_id", *empty, ntp(F.array(F.lit("10.0.0.1")), F.lit(None).cast("boolean")).alias("ntp"))
    return drift.document_changes(a, b)
