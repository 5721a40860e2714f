"""Vendor grammars as ordered tables of statements, compiled to columns.

A grammar gives each line its context with windows over the file: the open blocks of brace and
config/end grammars, the last unindented line of indented ones.  A statement is a condition on that
context and the text, and the facts that it writes; the first statement that matches wins, and lines
that no statement matches stay unclaimed.  Readings that need the whole file (a minimum, a closed
world) are facts whose path begins with ``~`` and are folded per file afterwards.  Only XML, whose
line numbers Spark's reader loses, is read by a function over whole files.

Facts: device_id, file, line_no, sub, path, op (set or append), entity, value, secret, claim.  Members
of list sections (interfaces, accounts, access lists) carry an ``entity``: the line that opened them.
Secrets leave ``parse`` as fingerprints only, so no table that is staged holds one in a column.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from plumbline.functions.reuse import per_session
from plumbline.functions.scalars import community_marker, credential_fingerprint, hash_algorithm, wildcard_prefix
from plumbline.operators.panxml import SHIPPED, read_files
from plumbline.sources.tables import spread, staged

FACT = "struct<path:string,op:string,entity:int,value:string,secret:string>"
FACTS = "device_id string, file string, line_no int, sub int, path string, op string, entity int, value string, secret string, claim boolean"


def _order() -> WindowSpec:
    return W.partitionBy("device_id", "file").orderBy("line_no")


def _above() -> WindowSpec:
    return _order().rowsBetween(W.unboundedPreceding, -1)




def fact(path: str, value: Column | str | None, op: str = "set", secret: Column | None = None, entity: Column | None = None) -> Column:
    v = F.lit(value) if value is None or isinstance(value, str) else value.cast("string")
    none = F.lit(None)
    return F.struct(F.lit(path).alias("path"), F.lit(op).alias("op"), (entity if entity is not None else none).cast("int").alias("entity"), v.cast("string").alias("value"), (secret if secret is not None else none).cast("string").alias("secret")).cast(FACT)


def add(path: str, value: Column | str, secret: Column | None = None) -> Column:
    return fact(path, value, "append", secret)


def g(pattern: str, i: int = 1) -> Column:
    return F.regexp_extract("text", pattern, i)


def got(pattern: str, i: int = 1) -> Column:
    """A group, null where it is empty."""
    return F.nullif(g(pattern, i), F.lit(""))


@dataclass(frozen=True)
class On:
    """A statement: a pattern, the facts, a further condition and whether the line counts as read."""

    pattern: str
    facts: tuple[Column, ...] = ()
    where: Column | None = None
    claim: bool = True

    def test(self) -> Column:
        hit = F.col("text").rlike(self.pattern)
        return hit if self.where is None else self.where & hit


def on(pattern: str, *facts: Column, where: Column | None = None, claim: bool = True) -> On:
    return On(pattern, facts, where, claim)


@dataclass(frozen=True)
class Compiled:
    """What a grammar's statements come to: the number of the one that matches, its facts, whether it claims."""

    number: Column
    facts: Column
    claims: Column


def compiled(statements: list[On]) -> Compiled:
    # one flat conditional each: nested ones would cost the optimiser more than the data costs
    number = reduce(lambda acc, ks: acc.when(ks[1].test(), ks[0]), enumerate(statements), F.when(F.lit(False), -1))
    none = F.array().cast(f"array<{FACT}>")
    made = reduce(lambda acc, ks: acc.when(F.col("k") == ks[0], F.array(*ks[1].facts)) if ks[1].facts else acc, enumerate(statements), F.when(F.lit(False), none))
    made = F.filter(F.coalesce(made, none), lambda f: f["path"].isNotNull())
    return Compiled(number, made, F.col("k").isin(*[k for k, s in enumerate(statements) if s.claim]))


def apply(rows: DataFrame, grammar: Compiled) -> DataFrame:
    """Facts of the first statement that matches each line."""
    hit = rows.withColumn("k", grammar.number).where("k is not null")
    out = hit.select("device_id", "file", "line_no", F.posexplode_outer(grammar.facts).alias("sub", "f"), grammar.claims.alias("claim"))
    return out.select("device_id", "file", "line_no", F.coalesce("sub", F.lit(0)).alias("sub"), "f.path", "f.op", "f.entity", "f.value", "f.secret", "claim")


# -- indented grammars ---------------------------------------------------------------------------

#: Fixed: unindented lines without a security fact, and harmless sub-commands.
GLOBALS = ["version ", "service ", "no service ", "boot-", "clock timezone", "ip domain-name", "ip name-server", "dns domain", "spanning-tree", "crypto key", "ip route ", "ip routing", "no ip routing", "transceiver ", "end", "exit", "ip ssh ", "ip forward-protocol", "aaa authorization"]
BENIGN = ["switchport ", "logging synchronous", "name ", "speed ", "duplex ", "mtu ", "channel-group ", "spanning-tree ", "storm-control ", "load-interval ", "no switchport", "authentication mode ", "encapsulation ", "vrf ", "standby ", "priority ", "remark "]


def _starts(*items: str) -> str:
    return "^(?:" + "|".join(x.replace(".", r"\.") for x in items) + ")"


PORT_WORDS = ["eq", "neq", "gt", "lt", "range"]


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ace_fields(rest: Column) -> Column:
    """protocol, src, src_port, dst, dst_port of an entry's remainder, read from its words in their order:
    protocol, address, ports, address, ports.  What isn't there is null, and words behind are left alone."""

    def address(t: Column, k: Column) -> Column:
        """The address at word k as a prefix, and the word behind it."""
        w, second = F.get(t, k), F.get(t, k + 1)
        plain = (w == "any") | F.contains(w, F.lit("/"))
        pair = F.coalesce(second.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.lit(False))
        value = (
            F.when(w.isNull() | plain, w).when(w == "host", F.coalesce(F.concat(second, F.lit("/32")), F.lit("any")))
            .when(pair, F.concat(w, F.lit("/"), wildcard_prefix(second).cast("string"))).otherwise(F.concat(w, F.lit("/32")))
        )
        return F.struct(value.alias("v"), (k + F.when(w.isNull(), 0).when(plain, 1).when((w == "host") | pair, 2).otherwise(1)).alias("k"))

    def ports(t: Column, k: Column) -> Column:
        w, second, third = F.get(t, k), F.get(t, k + 1), F.get(t, k + 2)
        there = F.coalesce(w.isin(*PORT_WORDS), F.lit(False))
        span = there & (w == "range") & third.isNotNull()
        value = F.when(span, F.concat_ws("-", second, third)).when(there & second.isNotNull(), F.concat_ws(" ", w, second))
        return F.struct(value.alias("v"), (k + F.when(span, 3).when(there, 2).otherwise(0)).alias("k"))

    words = F.filter(F.split(F.trim(rest), r"\s+"), lambda w: (w != "") & (w != "log"))
    return _let(words, lambda t: _let(address(t, F.lit(1)), lambda a: _let(ports(t, a["k"]), lambda p: _let(address(t, p["k"]), lambda d: F.struct(
        F.get(t, F.lit(0)).alias("protocol"), a["v"].alias("src"), p["v"].alias("src_port"), d["v"].alias("dst"), ports(t, d["k"])["v"].alias("dst_port")
    )))))


def _ace(rest: Column) -> list[Column]:
    """Facts of an access list entry, whose words are read in the column ``ace``."""
    e = F.col("line_no")
    read = [fact(f"acls.entries.{k}", F.col(f"ace.{k}"), entity=e) for k in ("protocol", "src", "src_port", "dst", "dst_port")]
    return [*read, fact("acls.entries.log", F.array_contains(F.split(rest, r"\s+"), "log"), entity=e)]


def indented(rows: DataFrame, dialect: str) -> DataFrame:
    """Lines of IOS-style files with block, argument and header line; banner bodies and blanks apart."""
    text = F.col("text")
    start = F.when(text.rlike(r"^banner (motd|login|exec) ."), F.struct("line_no", F.substring(F.regexp_extract("text", r"^banner (?:motd|login|exec) (.)", 1), 1, 1).alias("mark")))
    rows = rows.withColumn("banner", F.last(start, True).over(_order()))
    inside = W.partitionBy("device_id", "file", "banner.line_no").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    ends = F.col("banner").isNotNull() & (F.col("line_no") > F.col("banner.line_no")) & F.contains(text, F.col("banner.mark"))
    body = F.col("banner").isNotNull() & (F.col("line_no") > F.col("banner.line_no")) & ~F.coalesce(F.max(ends).over(inside), F.lit(False))
    rows = rows.withColumn("opaque", body | (text == "") | F.startswith(text, F.lit("!")))
    top = F.when(~F.col("opaque") & (F.col("indent") == 0), F.struct("line_no", "text"))
    rows = rows.withColumn("head", F.last(top, True).over(_order()))
    h = F.col("head.text")
    block = (
        F.when(h.rlike(r"^interface \S+"), "interface").when(h.rlike(r"^ip access-list (?:(?:standard|extended) )?\S+"), "acl").when(h.rlike("^line "), "line")
        .when(h.rlike("^(tacacs|radius) server"), "aaa-server").when(h.rlike(r"^vlan \d+"), "vlan")
    )
    if dialect == "arista":
        block = block.when(h == "management ssh", "m-ssh").when(h == "management telnet", "m-telnet").when(h.rlike("^management api http-commands"), "m-api")
    return rows.withColumn("block", F.when(F.col("indent") > 0, F.coalesce(block, F.lit("")))).withColumn("entity", F.col("head.line_no"))


#: An entry of an access list: its number, action and remainder.
ACE = r"^(?:(\d+) )?(permit|deny)\s+(.*)$"


def ios(rows: DataFrame, dialect: str = "cisco") -> DataFrame:
    rows = indented(rows, dialect).withColumn("ace", F.when(F.col("block") == "acl", ace_fields(g(ACE, 3))))
    return apply(rows, _ios(dialect))


@per_session
def _ios(dialect: str) -> Compiled:
    text = F.col("text")
    flat, e = F.col("block").isNull(), F.col("entity")
    within = lambda name: F.col("block") == name
    iface = lambda field, value: fact(f"interfaces.{field}", value, entity=e)
    user = r"^username (\S+)(?: privilege (\d+))?(?: role \S+)? (secret|password)(?: (\d+|sha512|sha256|md5|bcrypt))? (\S+)"
    kind, secret = got(user, 4), g(user, 5)
    algorithm = F.when(kind.isin("sha512", "sha256", "md5", "bcrypt"), kind).when((g(user, 3) == "password") & kind.isNull(), "plaintext").otherwise(hash_algorithm(secret, kind))
    name = r"^interface (\S+)"
    community = r"(?i)^snmp-server community (\S+)"
    marker = community_marker(g(community), SHIPPED["cisco"])
    acl = r"^ip access-list (?:(?:standard|extended) )?(\S+)"
    ace = ACE
    n = F.col("line_no")
    statements = [on(".*", where=F.col("opaque"))]
    top = [
        on(r"^hostname (\S+)", fact("device.hostname", g(r"^hostname (\S+)"))),
        on(name, fact("interfaces.name", g(name), entity=n), fact("interfaces.is_mgmt", F.lower(g(name)).rlike("^(management|vlan900|mgmt)"), entity=n), fact("interfaces.shutdown", "false", entity=n)),
        on(acl, fact("acls.name", g(acl), entity=n)),
        on("^line "),
    ]
    if dialect == "arista":
        top += [on("^management ssh$", fact("mgmt.ssh.enabled", "true")), on("^management telnet$"), on("^management api http-commands")]
    top += [
        on("^aaa new-model$|^aaa authentication login", fact("aaa.enabled", "true")),
        on("^no aaa root"),
        on("^aaa accounting", fact("aaa.accounting", "true")),
        on(user, fact("aaa.local_users.name", g(user), entity=n), fact("aaa.local_users.privilege", got(user, 2), entity=n), fact("aaa.local_users.hash", algorithm, entity=n, secret=secret)),
        on(r"^(?:tacacs|radius)-server host (\S+)", add("aaa.servers", g(r"^(?:tacacs|radius)-server host (\S+)"))),
        on("^(tacacs|radius) server"),
        on(r"^ip ssh version (\d)", fact("mgmt.ssh.version", g(r"^ip ssh version (\d)")), fact("mgmt.ssh.enabled", "true")),
        on(r"^ip ssh authentication-retries (\d+)", fact("mgmt.ssh.max_attempts", g(r"^ip ssh authentication-retries (\d+)"))),
        on("^no ip telnet server", fact("~telnet_server", "false")),
        on("^ip telnet server$", fact("~telnet_server", "true")),
        on("^ip http server$", fact("mgmt.http_enabled", "true")),
        on("^no ip http server$", fact("mgmt.http_enabled", "false")),
        on("^ip http secure-server$", fact("mgmt.https_enabled", "true")),
        on("^no ip http secure-server$", fact("mgmt.https_enabled", "false")),
        on(r"^logging trap (\S+)", fact("logging.level", g(r"^logging trap (\S+)"))),
        on(r"^logging (?:host )?(\d+\.\d+\.\d+\.\d+)", add("logging.servers", g(r"^logging (?:host )?(\d+\.\d+\.\d+\.\d+)"))),
        on(community, add("snmp.communities", marker, g(community)), fact("snmp.version", "2", secret=g(community))),
        on(r"^snmp-server group \S+ v3|^snmp-server user", fact("snmp.version", "3")),
        on("^snmp-server "),
        on(r"^ntp server \S+.* key ", add("ntp.servers", g(r"^ntp server (\S+)")), fact("ntp.authenticated", "true"), fact("~ntp", "1")),
        on(r"^ntp server (\S+)", add("ntp.servers", g(r"^ntp server (\S+)")), fact("~ntp", "1")),
        on("^ntp authenticate$", fact("ntp.authenticated", "true")),
        on("^ntp (authentication-key|trusted-key)"),
        on("^banner ", fact("mgmt.login_banner", "true")),
        on("^no (cdp|lldp) run$", fact("services.discovery_protocols", "false")),
        on("^(cdp|lldp) run$", fact("services.discovery_protocols", "true")),
        on("^no ip source-route", fact("services.source_routing", "false")),
        on("^ip source-route$", fact("services.source_routing", "true")),
        on(r"^vlan \d+"),
        on("^enable (secret|password) ", fact("aaa.enable_secret_hash", hash_algorithm(g(r"(\S+)$"), got(r"^enable \S+ (\S+) \S+")))),
        on(_starts(*GLOBALS)),
    ]
    statements += [On(s.pattern, s.facts, flat if s.where is None else s.where, s.claim) for s in top]
    vty = within("line") & F.col("head.text").rlike(r"^line\s+vty")
    statements += [
        on(r"^exec-timeout (\d+)", fact("~timeout", g(r"^exec-timeout (\d+)")), where=vty),
        on(r"^transport input .+", fact("~telnet_line", text.rlike(r"^transport input (?:.* )?(telnet|all)( |$)")), where=vty),
        on(r"^access-class (\S+) in", fact("~mgmt_acl", g(r"^access-class (\S+) in")), where=within("line")),
        on(r"^idle-timeout (\d+)", fact("~timeout", g(r"^idle-timeout (\d+)")), where=within("m-ssh")),
        on("^shutdown$", fact("mgmt.ssh.enabled", "false"), where=within("m-ssh")),
        on("^shutdown$", fact("~telnet_server", "false"), where=within("m-telnet")),
        on("^no shutdown$", fact("~telnet_server", "true"), where=within("m-telnet")),
        on(".*", where=within("m-telnet")),
        on("^no shutdown$", fact("mgmt.https_enabled", "true"), where=within("m-api")),
        on("^shutdown$", fact("mgmt.https_enabled", "false"), fact("mgmt.http_enabled", "false"), where=within("m-api")),
        on("^protocol https", fact("mgmt.https_enabled", "true"), where=within("m-api")),
        on("^protocol http", fact("mgmt.http_enabled", "true"), where=within("m-api")),
        on("^no protocol http(?!s)", fact("mgmt.http_enabled", "false"), where=within("m-api")),
        on("^description (.+)", iface("description", g("^description (.+)")), where=within("interface")),
        on(r"^ip access-group (\S+) in", iface("acl_in", g(r"^ip access-group (\S+) in")), where=within("interface")),
        on(r"^ip access-group (\S+) out", iface("acl_out", g(r"^ip access-group (\S+) out")), where=within("interface")),
        on(r"^ip address (\S+/\d+)", iface("addresses", g(r"^ip address (\S+/\d+)")), where=within("interface")),
        on(r"^ip address (\S+) (\S+)", iface("addresses", g(r"^ip address (\S+) (\S+)")), where=within("interface")),
        on(r"^switchport access vlan (\d+)", iface("vlan", g(r"^switchport access vlan (\d+)")), where=within("interface")),
        on("^shutdown$", iface("shutdown", "true"), where=within("interface")),
        on("^no shutdown$", iface("shutdown", "false"), where=within("interface")),
        on(ace, fact("acls.entries.acl", e, entity=n), fact("acls.entries.seq", got(ace, 1), entity=n), fact("acls.entries.action", g(ace, 2), entity=n), fact("acls.entries.raw", text, entity=n), fact("acls.entries.match", g(ace, 3), entity=n), *_ace(g(ace, 3)), where=within("acl")),
        on(r"^address ipv4 (\S+)", add("aaa.servers", g(r"^address ipv4 (\S+)")), where=within("aaa-server")),
        on(_starts(*BENIGN), where=F.col("block").isin("line", "m-ssh", "m-api", "interface", "acl", "aaa-server", "vlan")),
    ]
    return compiled(statements)


# -- nested grammars -----------------------------------------------------------------------------


def nested(rows: DataFrame, opens: Column, header: Column, closes: Column, levels: int = 16) -> DataFrame:
    """Lines with ``depth`` and ``path``: the headers of the blocks that are open above a line.

    A closing line belongs to the block that it closes.  The header of a level is the last one opened
    there, so no stack is carried along.  Lines below ``levels`` blocks are left out: they stay unread, and
    so are counted, rather than being read in a wrong place.
    """
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    above = F.coalesce(F.sum(step).over(_above()), F.lit(0))
    rows = rows.withColumns({"depth": F.greatest(above, F.lit(0)).cast("int"), "opens": opens, "header": header})
    heads = [F.last(F.when(F.col("opens") & (F.col("depth") == k), F.struct("line_no", "header")), True).over(_above()) for k in range(levels)]
    stack = F.slice(F.array(*heads), F.lit(1), F.least(F.col("depth"), F.lit(levels)))
    return rows.withColumn("stack", stack).where(F.col("depth") <= levels).withColumn("path", F.array_join(F.transform("stack", lambda h: h["header"]), " "))


#: Fixed: words that begin statements without a security fact.
JUNOS_QUIET = ["version", "uid", "class", "authorization", "system-generated-certificate", "rate-limit", "type", "peer-as", "neighbor", "accept", "log", "discard", "then", "protocol", "destination-port", "unit", "family", "inet"]
FORTIOS_QUIET = ["vdom", "type", "schedule", "srcintf", "dstintf", "action", "name", "timezone", "facility", "status", "syncinterval", "description", "admin-sport", "query-v1-status", "ntpsync"]


def junos(rows: DataFrame) -> DataFrame:
    text, path, header = F.col("text"), F.col("path"), F.col("header")
    full = F.when(path == "", header).otherwise(F.concat_ws(" ", path, header))
    rows = nested(rows, text.rlike(r"^.+\{$") & ~text.rlike(r"^(#|/\*)"), F.trim(F.regexp_extract("text", r"^(.+?)\s*\{$", 1)), text == "}")
    user = F.when(F.col("opens") & header.rlike("^user ") & F.startswith(full, F.lit("system login user")), F.element_at(F.split(header, r"\s+"), -1))
    return apply(rows.withColumn("user", F.last(user, True).over(_above())), _junos())


@per_session
def _junos() -> Compiled:
    text = F.col("text")
    path, e = F.col("path"), F.get("stack", F.lit(1))["line_no"]
    at = lambda p: path == p
    under = lambda p: F.startswith(path, F.lit(p))
    n, header = F.col("line_no"), F.col("header")
    full = F.when(path == "", header).otherwise(F.concat_ws(" ", path, header))
    community = r"^community (\S+)\s*\{$"
    inside = F.get("stack", F.lit(0))["header"].eqNullSafe(F.lit("interfaces")) & (F.size("stack") >= 2)
    account = F.when(at("system root-authentication"), "root").otherwise(F.col("user"))
    password = r'^(?:encrypted-password|plain-text-password)\s*"?([^";]*)"?;'
    algorithm = F.when(text.rlike("^plain-text-password"), "plaintext").otherwise(hash_algorithm(g(password), F.lit(None).cast("string")))
    level = r"(\S+);$"
    word = lambda w, p=r"\s+(\S+?);$": g(f"^{w}{p}")
    statements = [
        on(r"^$|^(#|/\*)|^\}$"),
        on(r"\{$", fact("~services", "1"), where=full == "system services"),
        on(r"\{$", fact("~ntp", "1"), where=full == "system ntp"),
        on(r"\{$", fact("interfaces.name", header, entity=n), fact("interfaces.shutdown", "false", entity=n), fact("interfaces.is_mgmt", header.rlike("^(fxp|em0|me0)"), entity=n), where=at("interfaces")),
        on(community, add("snmp.communities", community_marker(g(community), SHIPPED["juniper"]), g(community)), fact("snmp.version", "2", secret=g(community)), where=at("snmp")),
        on(r"\{$"),
        on(r"^[^;]*$"),
        on("^host-name ", fact("device.hostname", word("host-name")), where=at("system")),
        on(r"^idle-timeout \d+", fact("mgmt.idle_timeout_min", word("idle-timeout")), where=at("system login")),
        on("^protocol-version ", fact("mgmt.ssh.version", F.when(F.lower(word("protocol-version")).isin("v2", "2"), "2").otherwise("1")), fact("mgmt.ssh.enabled", "true"), where=at("system services ssh")),
        on(r"^connection-limit \d+", fact("mgmt.ssh.max_attempts", word("connection-limit")), where=at("system services ssh")),
        on(r"^ssh\b", fact("mgmt.ssh.enabled", "true"), fact("~services", "1"), where=at("system services")),
        on(r"^telnet\b", fact("mgmt.telnet_enabled", "true"), fact("~services", "1"), where=at("system services")),
        on(".*", fact("mgmt.https_enabled", "true"), where=under("system services web-management https")),
        on(".*", fact("mgmt.http_enabled", "true"), where=under("system services web-management http")),
        on("^(any|authorization) ", add("logging.servers", F.element_at(F.split(path, " "), -1)), fact("logging.level", g(level)), where=under("system syslog host ")),
        on("^server ", add("ntp.servers", g(r"^server (\S+?)[; ]")), fact("~ntp", "1"), where=at("system ntp")),
        on("^(authentication-key|trusted-key)", fact("ntp.authenticated", "true"), fact("~ntp", "1"), where=at("system ntp")),
        on(password, fact("aaa.local_users.name", account, entity=n), fact("aaa.local_users.hash", algorithm, entity=n, secret=g(password)), where=account.isNotNull()),
        on("^(encrypted-password|plain-text-password)"),
        on(".*", add("aaa.servers", g(level)), fact("aaa.enabled", "true"), where=under("system tacplus-server")),
        on("^tacplus-server", add("aaa.servers", g(level)), fact("aaa.enabled", "true")),
        on("^description ", fact("interfaces.description", g(r"^description (.*);$"), entity=e), where=inside),
        on("^address ", fact("interfaces.addresses", g(r"^address (\S+?)[; ]"), entity=e), where=inside),
        on("^input ", fact("interfaces.acl_in", g(r"^input (\S+?)[; ]"), entity=e), where=inside & F.contains(path, F.lit("filter"))),
        on("^disable;$", fact("interfaces.shutdown", "true", entity=e), where=inside),
        on(".*", where=under("firewall family inet filter ")),
        on("^(" + "|".join(JUNOS_QUIET) + r")\b"),
    ]
    return compiled(statements)


def fortios(rows: DataFrame) -> DataFrame:
    text = F.col("text")
    rows = nested(rows, text.rlike("^config .+$"), F.regexp_extract("text", "^config (.+)$", 1), text == "end")
    edit = F.when(text.rlike('^edit "?[^"]+"?$'), F.struct("line_no", F.regexp_extract("text", '^edit "?([^"]+)"?$', 1).alias("name"), F.lit(True).alias("open"))).when(
        text.isin("next", "end"), F.struct("line_no", F.lit("").alias("name"), F.lit(False).alias("open"))
    )
    rows = rows.withColumn("edit", F.last(edit, True).over(_order()))
    return apply(rows, _fortios())


@per_session
def _fortios() -> Compiled:
    path, n, e = F.col("path"), F.col("line_no"), F.col("edit.line_no")
    at = lambda p: path == p
    value = F.regexp_replace(F.trim(g(r"^set \S+\s*(.*)$")), '^"+|"+$', "")
    key = lambda k: f"^set {k}(?:\\s|$)"
    inside = at("system interface") & F.col("edit.open")
    yes = (value == "enable").cast("string")
    allowed = F.split(value, r"\s+")
    statements = [
        on("^$|^#|^config |^end$|^next$"),
        on("^edit ", fact("interfaces.name", F.col("edit.name"), entity=n), fact("interfaces.is_mgmt", "false", entity=n), fact("interfaces.shutdown", "false", entity=n), where=at("system interface")),
        on('^edit "?[^"]+"?$'),
        on(key("admintimeout"), fact("mgmt.idle_timeout_min", value), where=at("system global") & value.rlike(r"^\d+$")),
        on(key("admin-telnet"), fact("mgmt.telnet_enabled", yes), where=at("system global")),
        on(key("admin-ssh-v1"), fact("mgmt.ssh.version", F.when(value == "disable", "2").otherwise("1")), fact("mgmt.ssh.enabled", "true"), where=at("system global")),
        on(key("admin-https-redirect"), fact("mgmt.https_enabled", yes), where=at("system global")),
        on(key("hostname"), fact("device.hostname", value), where=at("system global")),
        on(key("admin-http"), fact("mgmt.http_enabled", yes), where=at("system global")),
        on(key("ip"), fact("interfaces.addresses", F.split_part(value, F.lit(" "), F.lit(1)), entity=e), where=inside),
        on(key("alias"), fact("interfaces.description", value, entity=e), F.when(F.lower(value).rlike("mgmt|management"), fact("interfaces.is_mgmt", "true", entity=e)).otherwise(fact("interfaces.alias", value, entity=e)), where=inside),
        on(key("status"), fact("interfaces.shutdown", (value == "down").cast("string"), entity=e), where=inside),
        on(key("allowaccess"), F.when(F.array_contains(allowed, "http"), fact("mgmt.http_enabled", "true")), F.when(F.array_contains(allowed, "telnet"), fact("mgmt.telnet_enabled", "true")), where=inside),
        on(key("trusthost1"), fact("interfaces.acl_in", "trusthost", entity=e), fact("mgmt.mgmt_acl", "trusthost"), where=inside),
        on(key("name"), add("snmp.communities", community_marker(value, SHIPPED["fortinet"]), value), fact("snmp.version", "2", secret=value), where=at("system snmp community")),
        on(key("security-level"), fact("snmp.version", "3"), where=at("system snmp user")),
        on(key("status"), where=at("system snmp sysinfo")),
        on(key("server"), add("logging.servers", value), where=at("log syslogd setting")),
        on(key("server"), add("ntp.servers", value), fact("~ntp", "1"), where=F.startswith(path, F.lit("system ntp"))),
        on(key("authentication"), fact("ntp.authenticated", yes), fact("~ntp", "1"), where=F.startswith(path, F.lit("system ntp"))),
        on("^set (" + "|".join(FORTIOS_QUIET) + r")(?:\s|$)", fact("~ntp", "1"), where=F.startswith(path, F.lit("system ntp"))),
        on(key("password"), fact("aaa.local_users.name", F.col("edit.name"), entity=n), fact("aaa.local_users.hash", None, entity=n), where=at("system admin") & F.col("edit.open")),
        on(key("accprofile"), where=at("system admin") & F.col("edit.open")),
        on("^set (" + "|".join(FORTIOS_QUIET) + r")(?:\s|$)"),
    ]
    return compiled(statements)


# -- flat grammar --------------------------------------------------------------------------------

#: Fixed: the fact that each management service of RouterOS switches.
SERVICES = {"telnet": "mgmt.telnet_enabled", "ssh": "mgmt.ssh.enabled", "www": "mgmt.http_enabled", "www-ssl": "mgmt.https_enabled"}


@per_session
def _routeros() -> Compiled:
    value = lambda k: F.try_element_at(F.filter("pairs", lambda p: p["k"] == k), F.lit(-1))["v"]
    has = lambda *ks: [value(k).isNotNull() for k in ks]
    path, n = F.col("command"), F.col("line_no")
    under = lambda p: F.startswith(path, F.lit(p))
    service = F.when(~F.contains(F.split_part("rest", F.lit(" "), F.lit(1)), F.lit("=")), F.split_part("rest", F.lit(" "), F.lit(1)))
    both = lambda *xs: reduce(and_, xs)
    known = path != ""
    community = F.coalesce(value("name"), F.lit(""))
    statements = [
        on("^$|^#"),
        on("^/", fact("device.hostname", value("name")), where=(path == "/system identity") & both(*has("name"))),
        *[on("^/", fact(p, (value("disabled") == "no").cast("string")), where=under("/ip service") & (service == s) & both(*has("disabled"))) for s, p in SERVICES.items()],
        on("^/", where=under("/ip service")),
        on("^/", add("snmp.communities", community_marker(community, SHIPPED["mikrotik"]), community), fact("snmp.version", "2", secret=community), where=under("/snmp community")),
        on("^/", where=(path == "/snmp") & both(*has("enabled"))),
        on("^/", add("ntp.servers", value("address")), fact("~ntp", "1"), where=under("/system ntp client servers") & both(*has("address"))),
        on("^/", add("logging.servers", value("remote")), where=under("/system logging action") & both(*has("remote"))),
        on("^/", fact("~address", F.concat_ws(" ", value("interface"), value("address"))), where=under("/ip address") & both(*has("interface"))),
        on("^/", fact("~comment", F.concat_ws(" ", F.coalesce(value("default-name"), value("name")), value("comment"))), where=under("/interface ethernet") & both(*has("comment"))),
        on("^/", fact("mgmt.mgmt_acl", "input-chain"), where=under("/ip firewall filter") & (value("chain") == "input") & (value("action") == "accept") & both(*has("dst-port", "src-address"))),
        on("^/", where=under("/ip firewall filter")),
        on("^/", fact("aaa.local_users.name", value("name"), entity=n), fact("aaa.local_users.hash", None, entity=n), where=under("/user") & both(*has("name"))),
        on("^/", where=under("/user")),
        on("^/", where=known & path.rlike(r"^/(system|interface)(\s|$)")),
    ]
    return compiled(statements)


def routeros(rows: DataFrame) -> DataFrame:
    command = r"^(/\S+(?:\s+\S+)*?)\s+(set|add|remove)\s+(.*)$"
    rest = F.regexp_extract("text", command, 3)
    pairs = F.transform(F.regexp_extract_all(rest, F.lit(r'(\S+?=(?:"[^"]*"|\S+))'), F.lit(1)), lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), F.regexp_replace(F.regexp_replace(p, "^[^=]*=", ""), '^"+|"+$', "").alias("v")))
    rows = rows.withColumn("command", F.regexp_extract("text", command, 1)).withColumn("rest", rest).withColumn("pairs", pairs)
    out = apply(rows, _routeros())
    # addresses name their interface; comments, wherever they stand, describe it
    seen = out.where("path in ('~address', '~comment')").select("*", F.split_part("value", F.lit(" "), F.lit(1)).alias("port"), F.regexp_replace("value", r"^\S+\s?", "").alias("rest"))
    by = W.partitionBy("device_id", "file", "port")
    seen = seen.withColumn("entity", F.min(F.when(F.col("path") == "~address", F.col("line_no"))).over(by)).withColumn("about", F.max_by(F.when(F.col("path") == "~comment", F.col("rest")), F.when(F.col("path") == "~comment", F.col("line_no"))).over(by))
    first = F.col("entity") == F.col("line_no")
    made = F.array(
        F.when(first, fact("interfaces.name", F.col("port"), entity=F.col("entity"))), F.when(first, fact("interfaces.shutdown", "false", entity=F.col("entity"))), F.when(first, fact("interfaces.is_mgmt", "false", entity=F.col("entity"))),
        F.when(first & F.col("about").isNotNull(), fact("interfaces.description", F.col("about"), entity=F.col("entity"))), F.when(F.col("rest") != "", fact("interfaces.addresses", F.col("rest"), entity=F.col("entity"))),
    )
    ports = seen.where("path = '~address'").select("device_id", "file", "line_no", F.posexplode(F.filter(made, lambda f: f.isNotNull())).alias("i", "f"), "claim")
    return out.unionByName(ports.select("device_id", "file", "line_no", (F.col("i") + 10).cast("int").alias("sub"), "f.path", "f.op", "f.entity", "f.value", "f.secret", "claim"))


# -- XML ------------------------------------------------------------------------------------------


def panos(rows: DataFrame) -> DataFrame:
    """A failing document yields one ``~error`` row instead of an exception.

    Files are dealt over all cores by number: few bytes of lines, which a shuffle would join into one task, are much work."""
    line = F.struct("line_no", "raw")
    texts = spread(rows.select("device_id", "file", "line_no", "raw"), "device_id", "file").groupBy("device_id", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["raw"]), "\n").alias("text"))
    return texts.mapInPandas(read_files, FACTS)


PARSERS = {"cisco": ios, "arista": lambda rows: ios(rows, "arista"), "juniper": junos, "fortinet": fortios, "mikrotik": routeros, "paloalto": panos}


def folded(facts: DataFrame) -> DataFrame:
    """Whole-file readings: what ``~`` observations come to, as facts that claim no line."""
    seen = facts.where("path like '~%' or path in ('ntp.authenticated', 'mgmt.telnet_enabled', 'mgmt.https_enabled', 'mgmt.http_enabled') or path in ('interfaces.is_mgmt', 'interfaces.acl_in')")
    of = lambda p, c="value": F.when(F.col("path") == p, F.col(c))
    line = lambda p: of(p, "line_no")
    yes = F.when((F.col("path") == "~telnet_line") & (F.col("value") == "true"), F.col("line_no"))
    managed = seen.where("path like 'interfaces.%' and vendor in ('cisco', 'arista')").groupBy("device_id", "file", "entity").agg(
        F.max(F.when(F.col("path") == "interfaces.is_mgmt", F.col("value"))).alias("m"), F.max_by(of("interfaces.acl_in"), line("interfaces.acl_in")).alias("acl"), F.max(line("interfaces.acl_in")).alias("acl_line")
    ).where("m = 'true' and acl is not null").groupBy("device_id", "file").agg(F.min(F.struct("entity", "acl", "acl_line")).alias("first"))
    a = seen.groupBy("device_id", "file").agg(
        F.min_by(line("~timeout"), F.when(F.col("path") == "~timeout", F.struct(F.col("value").cast("int"), F.col("line_no")))).alias("timeout_line"),
        F.min(F.when(F.col("path") == "~timeout", F.col("value").cast("int"))).alias("timeout"),
        F.min(yes).alias("telnet_yes"), F.min(line("~telnet_line")).alias("telnet_line"),
        F.max_by(of("~telnet_server"), line("~telnet_server")).alias("server"), F.max(line("~telnet_server")).alias("server_line"),
        F.max_by(of("~mgmt_acl"), line("~mgmt_acl")).alias("acl"), F.max(line("~mgmt_acl")).alias("acl_line"),
        F.min(line("~ntp")).alias("ntp_line"), F.min(line("~services")).alias("services_line"),
        *(F.max((F.col("path") == p).cast("int")).alias(n) for p, n in (("ntp.authenticated", "has_auth"), ("mgmt.telnet_enabled", "has_telnet"), ("mgmt.https_enabled", "has_https"), ("mgmt.http_enabled", "has_http"))),
    ).join(managed, ["device_id", "file"], "left")
    c = F.col
    row = lambda where, n, path, value: F.when(where, F.struct(n.alias("line_no"), F.lit(path).alias("path"), value.cast("string").alias("value")))
    made = F.array(
        row(c("timeout").isNotNull(), c("timeout_line"), "mgmt.idle_timeout_min", c("timeout")),
        row(c("telnet_line").isNotNull(), F.coalesce("telnet_yes", "telnet_line"), "mgmt.telnet_enabled", c("telnet_yes").isNotNull()),
        row(c("telnet_line").isNull() & c("server").isNotNull(), c("server_line"), "mgmt.telnet_enabled", c("server")),
        row(c("ntp_line").isNotNull() & (c("has_auth") == 0), c("ntp_line"), "ntp.authenticated", F.lit("false")),
        row(c("acl").isNotNull(), c("acl_line"), "mgmt.mgmt_acl", c("acl")),
        row(c("acl").isNull() & c("first").isNotNull(), c("first.acl_line"), "mgmt.mgmt_acl", c("first.acl")),
        row(c("services_line").isNotNull() & (c("has_telnet") == 0), c("services_line"), "mgmt.telnet_enabled", F.lit("false")),
        row(c("services_line").isNotNull() & (c("has_https") == 1) & (c("has_http") == 0), c("services_line"), "mgmt.http_enabled", F.lit("false")),
    )
    return a.select("device_id", "file", F.explode(F.filter(made, lambda r: r.isNotNull())).alias("r")).select(
        "device_id", "file", "r.line_no", F.lit(99).alias("sub"), "r.path", F.lit("set").alias("op"), F.lit(None).cast("int").alias("entity"), "r.value", F.lit(None).cast("string").alias("secret"), F.lit(False).alias("claim")
    )


_BLANK = {"path": "string", "op": "string", "entity": "int", "value": "string", "secret": "string"}


def parse(lines: DataFrame, vendors: DataFrame, hold_out: tuple[str, ...] = (), salt: bytes = b"local") -> DataFrame:
    """Facts of all configuration lines; ``vendors`` holds device_id and vendor.

    What the statements write is staged once; whole-file readings are then folded from that table.  A
    vendor in ``hold_out`` is read by no parser.
    """
    rows = lines.where("role = 'config'").join(vendors.select("device_id", "vendor"), "device_id")
    present = {r.vendor for r in vendors.select("vendor").distinct().collect()}  # at most as many as grammars
    shows = lines.where("role = 'show_output'").select("device_id", "file", "line_no", F.lit(0).alias("sub"), *(F.lit(None).cast(t).alias(n) for n, t in _BLANK.items()), F.lit(True).alias("claim"))
    own = [parser(rows.where(F.col("vendor") == vendor)).withColumn("vendor", F.lit(vendor)) for vendor, parser in PARSERS.items() if vendor in present and vendor not in hold_out]
    if not own:
        return shows
    bare = F.trim("secret")
    raw = staged(reduce(DataFrame.unionByName, own).withColumn("secret", F.when(F.length(bare) > 0, credential_fingerprint(salt, bare))), "statements")
    more = folded(raw)
    observed = F.col("path").like("~%") & (F.col("path") != "~error")
    # an observation claims its line and is no fact
    kept = raw.drop("vendor").withColumns({n: F.when(F.coalesce(observed, F.lit(False)), F.lit(None).cast(t)).otherwise(F.col(n)) for n, t in _BLANK.items() if n != "path"} | {"path": F.when(F.coalesce(observed, F.lit(False)), F.lit(None)).otherwise(F.col("path"))})
    return kept.unionByName(more).unionByName(shows)
