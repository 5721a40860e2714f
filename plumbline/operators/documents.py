"""From facts to device documents, coverage and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.scalars import MARK, credential_fingerprint, redact

#: The scalar and list paths of a document, by kind; struct sections follow from their names.
SCALARS = {
    "mgmt.telnet_enabled": "boolean", "mgmt.http_enabled": "boolean", "mgmt.https_enabled": "boolean", "mgmt.idle_timeout_min": "int", "mgmt.login_banner": "boolean",
    "mgmt.mgmt_acl": "string", "mgmt.ssh.enabled": "boolean", "mgmt.ssh.version": "int", "mgmt.ssh.ciphers": "array", "mgmt.ssh.kex": "array", "mgmt.ssh.macs": "array", "mgmt.ssh.max_attempts": "int",
    "aaa.enabled": "boolean", "aaa.servers": "array", "aaa.accounting": "boolean", "aaa.enable_secret_hash": "string",
    "aaa.password_policy.min_length": "int", "aaa.password_policy.complexity": "boolean", "aaa.password_policy.max_age_days": "int",
    "snmp.version": "int", "snmp.communities": "array", "snmp.acl": "string", "snmp.traps": "array",
    "logging.servers": "array", "logging.level": "string", "logging.timestamps": "boolean", "logging.buffered": "boolean",
    "ntp.servers": "array", "ntp.authenticated": "boolean", "ntp.source": "string",
    "routing.protocols": "array", "routing.neighbour_authentication": "boolean",
    "services.discovery_protocols": "boolean", "services.source_routing": "boolean", "services.proxy_arp": "boolean", "services.unused": "array",
    "crypto.tls_versions": "array", "crypto.ike_proposals": "array",
}
DEVICE = ["hostname", "version", "model", "serial"]
SAMPLE = 250
EVIDENCE, RADIUS = 5, 3


def _when(path: str, c: str = "value") -> Column:
    return F.when(F.col("path") == path, F.col(c))


def _struct(prefix: str, made: dict[str, Column], extra: dict[str, Column] | None = None) -> Column:
    """A section: null if nothing in it was written."""
    inner: dict[str, Column] = {}
    for path, column in made.items():
        if path.startswith(prefix + "."):
            head, _, rest = path[len(prefix) + 1 :].partition(".")
            inner[head] = _struct(f"{prefix}.{head}", made) if rest else column
    inner |= extra or {}
    some = F.coalesce(*(F.when(c.isNotNull(), True) for c in inner.values()))
    return F.when(some, F.struct(*(c.alias(k) for k, c in inner.items())))


def documents(facts: DataFrame, devices: DataFrame) -> DataFrame:
    """One document per row of ``devices`` (device_id, vendor, os, confidence_bp, identity columns).

    A later write of a path wins; lists keep the order of the file; sections that nothing was written to
    are null.
    """
    order = F.struct("file", "line_no", "sub")
    flat = facts.where("path is not null and entity is null")
    made, aggregates = {}, []
    for path, kind in SCALARS.items():
        name = path.replace(".", "__")
        if kind == "array":
            aggregates.append(F.array_sort(F.collect_list(F.when(F.col("path") == path, F.struct(order.alias("o"), F.col("value").alias("v"))))).alias(name))
            made[path] = F.when(F.size(name) > 0, F.transform(name, lambda x: x["v"]))
        else:
            aggregates.append(F.max_by(_when(path), F.when(F.col("path") == path, order)).alias(name))
            made[path] = F.col(name).cast(kind)
    for name in DEVICE:
        p = f"device.{name}"
        aggregates.append(F.max_by(_when(p), F.when(F.col("path") == p, order)).alias(f"d_{name}"))
    wide = flat.groupBy("device_id").agg(*aggregates)

    members = facts.where("entity is not null")
    last = lambda p: F.max_by(_when(p), F.when(F.col("path") == p, order))
    fields = lambda base, names: [last(f"{base}.{n}").alias(n) for n in names]
    inter = members.where("path like 'interfaces.%'").groupBy("device_id", "file", "entity").agg(
        *fields("interfaces", ["name", "description", "acl_in", "acl_out", "zone", "vlan", "shutdown", "is_mgmt"]),
        F.array_sort(F.collect_list(F.when(F.col("path") == "interfaces.addresses", F.struct(order.alias("o"), F.col("value").alias("v"))))).alias("list"),
    )
    managed = F.coalesce(F.col("is_mgmt") == "true", F.lit(False)) | ((F.size("list") > 0) & F.lower(F.coalesce("description", F.lit(""))).contains("management") & F.col("file").isNotNull() & F.col("by_text"))
    inter = inter.join(devices.select("device_id", F.col("vendor").isin("cisco", "arista").alias("by_text")), "device_id")
    one = F.struct(
        F.col("file").alias("f"), F.col("entity").alias("e"),
        F.struct("name", "description", F.transform("list", lambda x: x["v"]).alias("addresses"), "acl_in", "acl_out", "zone", F.col("vlan").cast("int").alias("vlan"), F.coalesce(F.col("shutdown") == "true", F.lit(False)).alias("shutdown"), managed.alias("is_mgmt")).alias("x"),
    )
    inter = inter.groupBy("device_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda r: r["x"]).alias("interfaces"))

    users = members.where("path like 'aaa.local_users.%'").groupBy("device_id", "file", "entity").agg(
        *fields("aaa.local_users", ["name", "privilege", "hash"]), F.max("secret").alias("secret")
    )
    user = F.struct(F.col("file").alias("f"), F.col("entity").alias("e"), F.struct("name", F.col("privilege").cast("int").alias("privilege"), "hash", F.col("secret").alias("hash_fingerprint")).alias("x"))
    users = users.groupBy("device_id").agg(F.transform(F.array_sort(F.collect_list(user)), lambda r: r["x"]).alias("local_users"))

    names = members.where("path = 'acls.name'").select("device_id", "file", F.col("entity").alias("acl"), F.col("value").alias("acl_name"))
    entries = members.where("path like 'acls.entries.%'").groupBy("device_id", "file", "entity").agg(
        *fields("acls.entries", ["acl", "seq", "action", "protocol", "src", "dst", "src_port", "dst_port", "log", "raw", "match"])
    ).withColumn("acl", F.col("acl").cast("int"))
    place = F.row_number().over(W.partitionBy("device_id", "file", "acl").orderBy("entity"))
    entries = entries.withColumn("seq", F.coalesce(F.col("seq").cast("int"), place * 10))
    entry = F.struct(F.col("entity").alias("e"), F.struct("seq", "action", "protocol", "src", "dst", "src_port", "dst_port", (F.col("log") == "true").alias("log"), "raw", "match").alias("x"))
    entries = entries.groupBy("device_id", "file", "acl").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda r: r["x"]).alias("entries"))
    acls = names.join(entries, ["device_id", "file", "acl"], "left")
    nothing = F.array().cast(entries.schema["entries"].dataType)
    acls = acls.groupBy("device_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("file", "acl", F.struct(F.col("acl_name").alias("name"), F.coalesce("entries", nothing).alias("entries")).alias("x")))), lambda r: r["x"]).alias("acls"))

    out = devices.join(wide, "device_id", "left").join(inter, "device_id", "left").join(users, "device_id", "left").join(acls, "device_id", "left")
    known = {n: F.coalesce(f"d_{n}", n) if n in devices.columns else F.col(f"d_{n}") for n in DEVICE}
    device = F.struct(F.coalesce("vendor", F.lit("unknown")).alias("vendor"), "os", *(known[n].alias(n) for n in ("version", "model", "serial", "hostname")), F.col("confidence_bp").alias("fingerprint_confidence_bp"))
    sections = [_struct(s, made, {"local_users": F.col("local_users")} if s == "aaa" else None).alias(s) for s in ("mgmt", "aaa", "snmp", "logging", "ntp", "routing", "services", "crypto")]
    return out.select("device_id", device.alias("device"), *sections, "interfaces", "acls")


def coverage(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """Per device: total, parsed and unparsed lines, lines by tier, percent, and a sample of the rest.

    The lowest tier that claims a line counts; ``facts`` without a tier are of tier 0.
    """
    tier = F.col("tier") if "tier" in facts.columns else F.lit(0)
    claims = facts.where("claim").groupBy("device_id", "file", "line_no").agg(F.min(tier).alias("tier"))
    rows = lines.select("device_id", "file", "line_no", "raw").join(claims.hint("merge"), ["device_id", "file", "line_no"], "left")
    rank = F.row_number().over(W.partitionBy("device_id", F.col("tier").isNull()).orderBy("file", "line_no"))
    rows = rows.withColumn("k", rank)
    rest = F.when(F.col("tier").isNull() & (F.col("k") <= SAMPLE), F.struct("file", "line_no", redact(F.col("raw")).alias("raw")))
    parsed = F.count_if(F.col("tier").isNotNull())
    return rows.groupBy("device_id").agg(
        F.count("*").alias("total_lines"), parsed.alias("parsed_lines"), F.count_if(F.col("tier").isNull()).alias("unparsed_lines"),
        *(F.count_if(F.col("tier") == t).alias(f"tier{t}") for t in range(4)),
        F.when(F.count("*") == 0, 0.0).otherwise(F.bround(100.0 * parsed / F.count("*"), 1)).alias("percent"), F.array_sort(F.collect_list(rest)).alias("unparsed_sample"),
    )


def residue(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """Lines that nothing claims.  Staged tables compress well, so their sizes would pass for ones to broadcast: what
    grows with the lines is merged."""
    return lines.join(facts.where("claim").select("device_id", "file", "line_no").distinct().hint("merge"), ["device_id", "file", "line_no"], "left_anti")


def scrubbed(line: Column, secrets: Column, salt: bytes) -> Column:
    """A redacted line without words whose fingerprint is among the device's secrets, quotes aside.

    Secrets are known by their fingerprints only; a line whose device has none is redacted by patterns.
    """
    clean = redact(line)
    words = F.array_distinct(F.transform(F.split(F.trim(clean), r"\s+"), lambda w: F.regexp_replace(w, "^[\"';,]+|[\"';,]+$", "")))
    known = F.filter(words, lambda w: (F.length(w) >= 2) & (w != MARK) & F.array_contains(secrets, credential_fingerprint(salt, w)))
    return F.when(F.size(F.coalesce(secrets, F.array().cast("array<string>"))) == 0, clean).otherwise(F.aggregate(known, clean, lambda text, w: F.replace(text, w, F.lit(MARK))))


def secrets_of(facts: DataFrame) -> DataFrame:
    """device_id, secrets: the fingerprints of a device's secrets."""
    return facts.where("secret is not null").groupBy("device_id").agg(F.collect_set("secret").alias("secrets"))


def evidence(found: DataFrame, facts: DataFrame, lines: DataFrame, salt: bytes = b"local") -> DataFrame:
    """device_id, rule_id, ir_path, file, line_no, raw and excerpt: at most five citations per finding.

    A path cites its last write; a list or a section that was written member by member cites the first.
    Excerpts are an equi-join on the seven lines around a citation, not a range join.
    """
    touched = found.select("device_id", "rule_id", F.posexplode("touched").alias("k", "ir_path"))
    base = F.when(F.col("entity").isNotNull(), F.regexp_extract("path", r"^(interfaces|acls|aaa\.local_users)", 1)).otherwise(F.col("path"))
    member = F.col("entity").isNotNull() | (F.col("op") == "append")
    cited = facts.where("path is not null").select("device_id", base.alias("ir_path"), "file", "line_no", "sub", member.alias("member"))
    order = F.struct("file", "line_no", "sub")
    best = cited.groupBy("device_id", "ir_path").agg(F.coalesce(F.max(F.when(~F.col("member"), order)), F.min(order)).alias("at"))
    hits = touched.join(best.hint("merge"), ["device_id", "ir_path"])
    hits = hits.withColumn("n", F.row_number().over(W.partitionBy("device_id", "rule_id").orderBy("k"))).where(F.col("n") <= EVIDENCE)
    hits = hits.select("device_id", "rule_id", "ir_path", "n", F.col("at.file").alias("file"), F.col("at.line_no").alias("line_no"))
    around = hits.withColumn("near", F.explode(F.sequence(F.col("line_no") - RADIUS, F.col("line_no") + RADIUS)))
    # findings share lines: each is scrubbed once, then goes to all that cite it
    around = around.groupBy("device_id", "file", "near").agg(F.collect_list(F.struct("rule_id", "ir_path", "n", "line_no")).alias("cites"))
    near = lines.select("device_id", "file", F.col("line_no").alias("near"), "raw")
    clean = around.join(near.hint("merge"), ["device_id", "file", "near"]).join(secrets_of(facts).hint("merge"), "device_id", "left").withColumn("clean", scrubbed(F.col("raw"), F.col("secrets"), salt))
    joined = clean.select("device_id", "file", "near", "clean", F.inline("cites"))
    piece = F.struct(F.col("near").alias("line"), F.col("clean").alias("text"), (F.col("near") == F.col("line_no")).alias("cited"))
    held = joined.groupBy("device_id", "rule_id", "ir_path", "n", "file", "line_no").agg(F.array_sort(F.collect_list(piece)).alias("excerpt"))
    raw = F.array_max(F.transform(F.filter("excerpt", lambda x: x["cited"]), lambda x: x["text"]))
    return held.select("device_id", "rule_id", "ir_path", "n", "file", "line_no", raw.alias("raw"), "excerpt")
