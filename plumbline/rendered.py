"""Configurations rendered from the supplier table, and what must be read from them.

A vendor is a list of lines.  A line is a text whose ``[[...]]`` are SQL expressions over a device's
numbers (k: its key, q: k or a sixth of it, nat: its nation, n: k modulo 250 plus 1, name), a condition,
and the facts that it gives.  From the list follow the text, as a Spark expression, and the facts with
their line numbers, as SQL that reads no text: so a grammar is compared with what the line means.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.tables import spread


@dataclass(frozen=True)
class Line:
    text: str
    facts: tuple
    when: str = "true"
    claim: bool = True
    tag: str | None = None


def L(text: str, *facts, when: str = "true", claim: bool = True, tag: str | None = None) -> Line:  # noqa: N802
    return Line(text, facts, when, claim, tag)


def sql_text(template: str | None) -> str:
    if template is None:
        return "CAST(NULL AS STRING)"
    parts = re.split(r"\[\[(.*?)\]\]", template)
    made = [f"({p})" if k % 2 else "'" + p.replace("'", "''") + "'" for k, p in enumerate(parts) if p or not k]
    return " || ".join(made)


def ace(text: str, seq, action, protocol, src=None, src_port=None, dst=None, dst_port=None, log="false") -> Line:
    """An access list entry and its parts."""
    match = re.sub(r"^(\d+ )?(permit|deny) ", "", text)
    named = {"seq": seq, "action": action, "raw": text, "match": match, "protocol": protocol, "src": src, "src_port": src_port, "dst": dst, "dst_port": dst_port, "log": log}
    return L(" " + text, *((f"acls.entries.{k}", v) for k, v in named.items()))


def iface(text: str, name: str, mgmt: str = "false", **more) -> Line:
    return L(text, ("interfaces.name", name), ("interfaces.is_mgmt", mgmt), ("interfaces.shutdown", "false"), **more)


COMMUNITY = "[[CASE WHEN q % 2 = 0 THEN 'public' ELSE 'hush' || k END]]"
MARKER = (("snmp.communities", "[[CASE WHEN q % 2 = 0 THEN 'default' ELSE 'custom' END]]"), ("snmp.version", "2"))
TELNET = "[[CASE WHEN q % 3 = 0 THEN 'true' ELSE 'false' END]]"

CISCO = [
    L("version 15.2"), L("service timestamps log datetime"), L("!"),
    L("hostname [[name]]", ("device.hostname", "[[name]]")),
    L("aaa new-model", ("aaa.enabled", "true"), when="q % 2 = 0"),
    L("aaa accounting exec default start-stop group tacacs+", ("aaa.accounting", "true"), when="q % 3 = 0"),
    L("tacacs server T1"), L(" address ipv4 10.[[nat]].0.20", ("aaa.servers", "10.[[nat]].0.20")),
    L("username ops privilege 15 secret 9 $9$h[[q % 7]]", ("aaa.local_users.name", "ops"), ("aaa.local_users.privilege", "15"), ("aaa.local_users.hash", "scrypt")),
    L("username old password 7 0822[[k]]", ("aaa.local_users.name", "old"), ("aaa.local_users.privilege", None), ("aaa.local_users.hash", "reversible"), when="q % 4 = 0"),
    L("enable secret 5 $1$mERr$hx5", ("aaa.enable_secret_hash", "md5"), when="q % 5 <> 0"),
    L("ip ssh version [[1 + q % 2]]", ("mgmt.ssh.version", "[[1 + q % 2]]"), ("mgmt.ssh.enabled", "true")),
    L("ip ssh authentication-retries [[q % 5]]", ("mgmt.ssh.max_attempts", "[[q % 5]]")),
    L("ip http server", ("mgmt.http_enabled", "true"), when="q % 3 = 1"),
    L("no ip http server", ("mgmt.http_enabled", "false"), when="q % 3 <> 1"),
    L("no ip http secure-server", ("mgmt.https_enabled", "false")),
    L("no ip telnet server", when="q % 7 = 0"),
    L("unknown-thing [[k]]", claim=False), L("spanning-tree mode pvst"),
    iface("interface GigabitEthernet0/1", "GigabitEthernet0/1"),
    L(" description uplink to internet", ("interfaces.description", "uplink to internet")),
    L(" ip address 198.51.[[nat]].[[n]] 255.255.255.0", ("interfaces.addresses", "198.51.[[nat]].[[n]]")),
    L(" speed 100"), L(" mystery [[k]]", claim=False),
    iface("interface Vlan900", "Vlan900", "true"),
    L(" ip address 10.[[nat]].9.[[n]]/24", ("interfaces.addresses", "10.[[nat]].9.[[n]]/24")),
    L(" ip access-group MGMT in", ("interfaces.acl_in", "MGMT"), tag="acl_in"),
    L(" shutdown", ("interfaces.shutdown", "true"), when="q % 9 = 4"),
    L("ip access-list extended MGMT", ("acls.name", "MGMT")),
    ace("permit ip any any", None, "permit", "ip", "any", None, "any"),
    ace("20 deny tcp 10.0.0.0 0.0.0.255 any eq 22 log", "20", "deny", "tcp", "10.0.0.0/24", None, "any", "eq 22", "true"),
    ace("permit tcp host 10.1.1.1 any range 80 443", None, "permit", "tcp", "10.1.1.1/32", None, "any", "80-443"),
    ace("permit tcp any any established", None, "permit", "tcp", "any", None, "any"),
    ace("deny udp 10.2.0.0/16 eq 53 host 10.3.3.3 gt 1023", None, "deny", "udp", "10.2.0.0/16", "eq 53", "10.3.3.3/32", "gt 1023"),
    ace("permit 10.0.0.0 0.0.0.255", None, "permit", "10.0.0.0", "0.0.0.255/32"), ace("deny any log", None, "deny", "any", log="true"),
    L("logging trap informational", ("logging.level", "informational")),
    L("logging host 10.[[nat]].0.5", ("logging.servers", "10.[[nat]].0.5"), when="q % 10 <> 7"),
    L(f"snmp-server community {COMMUNITY} RO", *MARKER),
    L("snmp-server group G v3 priv", ("snmp.version", "3"), when="q % 6 = 0"), L("snmp-server location here"),
    L("ntp server 10.[[nat]].0.1[[CASE WHEN q % 4 = 0 THEN ' key 1' ELSE '' END]]", ("ntp.servers", "10.[[nat]].0.1"), ("ntp.authenticated", "true", "q % 4 = 0"), tag="ntp"),
    L("banner motd ^", ("mgmt.login_banner", "true")), L(" hostname fake"), L("^"),
    L("no cdp run", ("services.discovery_protocols", "false")), L("no ip source-route", ("services.source_routing", "false")),
    L("vlan 10"), L(" name users"),
    L("line con 0"), L(" exec-timeout 5 0", claim=False),
    L("line vty 0 4"), L(" exec-timeout [[q % 30]] 0", tag="t1"),
    L(" transport input [[CASE WHEN q % 3 = 0 THEN 'telnet ssh' ELSE 'ssh' END]]", tag="tr1"),
    L(" access-class VTY in", when="q % 8 = 0", tag="vty"),
    L("line vty 5 15"), L(" exec-timeout 12 0", tag="t2"), L(" transport input ssh"), L("end"),
]
ARISTA = [
    L("hostname [[name]]", ("device.hostname", "[[name]]")), L("transceiver qsfp default-mode 4x10G"), L("no aaa root"),
    L("username ops privilege 15 role network-admin secret sha512 $6$same$hash[[q % 3]]", ("aaa.local_users.name", "ops"), ("aaa.local_users.privilege", "15"), ("aaa.local_users.hash", "sha512")),
    L("aaa authentication login default group tacacs+", ("aaa.enabled", "true")),
    L("tacacs-server host 10.0.0.20", ("aaa.servers", "10.0.0.20")),
    L("ntp authenticate", ("ntp.authenticated", "true"), when="q % 2 = 0"),
    L("ntp server 10.0.[[nat]].1", ("ntp.servers", "10.0.[[nat]].1"), tag="ntp"),
    L("management ssh", ("mgmt.ssh.enabled", "true")), L("   idle-timeout [[q % 20]]", tag="idle"), L("   shutdown", ("mgmt.ssh.enabled", "false"), when="q % 5 = 0"),
    L("management telnet"), L("   [[CASE WHEN q % 3 = 0 THEN 'no shutdown' ELSE 'shutdown' END]]", tag="telnet"),
    L("management api http-commands"), L("   no shutdown", ("mgmt.https_enabled", "true")), L("   protocol http", ("mgmt.http_enabled", "true"), when="q % 4 = 1"),
    iface("interface Ethernet1", "Ethernet1"), L("   ip address 10.[[nat]].0.[[n]]/24", ("interfaces.addresses", "10.[[nat]].0.[[n]]/24")),
    L("   switchport access vlan [[q % 90]]", ("interfaces.vlan", "[[q % 90]]")),
    L(f"snmp-server community {COMMUNITY} RO", *MARKER), L("daemon strange", claim=False),
]
JUNIPER = [
    L("version 21.4R3;"), L("system {"), L("    host-name [[name]];", ("device.hostname", "[[name]]")),
    L("    login {"), L("        idle-timeout [[q % 25]];", ("mgmt.idle_timeout_min", "[[q % 25]]")), L("        user ops {"), L("            class super-user;"), L("            authentication {"),
    L('                encrypted-password "$6$same$hash[[q % 4]]";', ("aaa.local_users.name", "ops"), ("aaa.local_users.hash", "sha512")), L("            }"), L("        }"), L("    }"),
    L("    services {", tag="services"), L("        ssh {"), L("            protocol-version v2;", ("mgmt.ssh.version", "2"), ("mgmt.ssh.enabled", "true")),
    L("            connection-limit [[q % 9 + 1]];", ("mgmt.ssh.max_attempts", "[[q % 9 + 1]]")), L("        }"),
    L("        telnet;", ("mgmt.telnet_enabled", "true"), when="q % 3 = 0"),
    L("        web-management {"), L("            https {"), L("                port 443;", ("mgmt.https_enabled", "true")), L("            }"), L("        }"), L("    }"),
    L("    syslog {"), L("        host 10.0.[[nat]].5 {"), L("            any info;", ("logging.servers", "10.0.[[nat]].5"), ("logging.level", "info")), L("        }"), L("    }"),
    L("    ntp {", tag="ntp"), L("        server 10.0.[[nat]].1;", ("ntp.servers", "10.0.[[nat]].1")), L("        trusted-key 1;", ("ntp.authenticated", "true"), when="q % 4 = 0"), L("    }"), L("}"),
    L("snmp {"), L(f"    community {COMMUNITY} {{", *MARKER), L("        authorization read-only;"), L("    }"), L("}"),
    L("interfaces {"), iface("    ge-0/0/0 {", "ge-0/0/0"), L("        description wan;", ("interfaces.description", "wan")), L("        unit 0 {"), L("            family inet {"),
    L("                address 203.0.[[nat]].[[n]]/24;", ("interfaces.addresses", "203.0.[[nat]].[[n]]/24")), L("            }"), L("        }"), L("    }"),
    iface("    ge-0/0/1 {", "ge-0/0/1"), L("        unit 0 {"), L("            family inet {"), L("                filter {"), L("                    input CORE;", ("interfaces.acl_in", "CORE")), L("                }"),
    L("                address 10.[[nat]].0.[[n]]/24;", ("interfaces.addresses", "10.[[nat]].0.[[n]]/24")), L("            }"), L("        }"), L("        disable;", ("interfaces.shutdown", "true"), when="q % 5 = 1"), L("    }"), L("}"),
    L("mystery [[k]];", claim=False),
]
FORTINET = [
    L("#config-version=FGT-7.2"), L("config system global"), L('    set hostname "[[name]]"', ("device.hostname", "[[name]]")), L("    set admintimeout [[q % 40]]", ("mgmt.idle_timeout_min", "[[q % 40]]")),
    L("    set admin-telnet [[CASE WHEN q % 3 = 0 THEN 'enable' ELSE 'disable' END]]", ("mgmt.telnet_enabled", TELNET)),
    L("    set admin-ssh-v1 disable", ("mgmt.ssh.version", "2"), ("mgmt.ssh.enabled", "true")), L("    set admin-https-redirect enable", ("mgmt.https_enabled", "true")), L("    set mystery [[k]]", claim=False), L("end"),
    L("config system interface"), iface('    edit "port1"', "port1"), L("        set ip 10.[[nat]].0.[[n]] 255.255.255.0", ("interfaces.addresses", "10.[[nat]].0.[[n]]")),
    L("        set allowaccess ping https ssh[[CASE WHEN q % 5 = 0 THEN ' http' ELSE '' END]]", ("mgmt.http_enabled", "true", "q % 5 = 0")),
    L('        set alias "management lan"', ("interfaces.description", "management lan"), ("interfaces.is_mgmt", "true")), L("        set status down", ("interfaces.shutdown", "true"), when="q % 6 = 1"),
    L("        set trusthost1 10.0.0.0 255.255.255.0", ("interfaces.acl_in", "trusthost"), ("mgmt.mgmt_acl", "trusthost"), when="q % 4 = 0"), L("    next"), L("end"),
    L("config system snmp community"), L("    edit 1"), L(f'        set name "{COMMUNITY}"', *MARKER), L("    next"), L("end"),
    L("config log syslogd setting"), L("    set status enable"), L('    set server "10.0.[[nat]].5"', ("logging.servers", "10.0.[[nat]].5")), L("end"),
    L("config system ntp"), L("    set ntpsync enable", tag="ntp"), L("    config ntpserver"), L("        edit 1"), L('            set server "10.0.[[nat]].1"', ("ntp.servers", "10.0.[[nat]].1")),
    L("            set authentication enable", ("ntp.authenticated", "true"), when="q % 2 = 0"), L("        next"), L("    end"), L("end"),
    L("config system admin"), L('    edit "admin"'), L('        set accprofile "super_admin"'), L("        set password ENC [[k]]", ("aaa.local_users.name", "admin"), ("aaa.local_users.hash", None)), L("    next"), L("end"),
]
MIKROTIK = [
    L("# by RouterOS 7.14"), L("/system identity set name=[[name]]", ("device.hostname", "[[name]]")),
    L("/ip service set telnet disabled=[[CASE WHEN q % 3 = 0 THEN 'no' ELSE 'yes' END]]", ("mgmt.telnet_enabled", TELNET)), L("/ip service set ssh disabled=no", ("mgmt.ssh.enabled", "true")),
    L("/ip service set www disabled=yes", ("mgmt.http_enabled", "false")), L("/ip service set www-ssl disabled=no", ("mgmt.https_enabled", "true")), L("/ip service set api disabled=yes"),
    L(f"/snmp community add name={COMMUNITY}", *MARKER), L("/snmp set enabled=yes"),
    L("/system ntp client servers add address=10.0.[[nat]].1", ("ntp.servers", "10.0.[[nat]].1"), tag="ntp"), L("/system logging action set remote=10.0.[[nat]].5 name=remote", ("logging.servers", "10.0.[[nat]].5")),
    L('/interface ethernet set default-name=ether1 comment="wan side"'),
    L("/ip address add address=203.0.[[nat]].[[n]]/24 interface=ether1", ("interfaces.name", "ether1"), ("interfaces.shutdown", "false"), ("interfaces.is_mgmt", "false"), ("interfaces.description", "wan side"), ("interfaces.addresses", "203.0.[[nat]].[[n]]/24")),
    L("/ip firewall filter add chain=input action=accept dst-port=22 src-address=10.0.0.0/8", ("mgmt.mgmt_acl", "input-chain"), when="q % 4 = 0"),
    L("/user add name=ops group=full", ("aaa.local_users.name", "ops"), ("aaa.local_users.hash", None)), L("/tool strange add x=[[k]]", claim=False),
]
PALOALTO = [
    L('<?xml version="1.0"?>'), L('<config version="10.1.0" urldb="paloaltonetworks">'), L("<mgt-config>"), L("<password-complexity>"), L("<enabled>yes</enabled>", ("aaa.password_policy.complexity", "true")),
    L("<minimum-length>[[8 + q % 8]]</minimum-length>", ("aaa.password_policy.min_length", "[[8 + q % 8]]")), L("</password-complexity>"), L("</mgt-config>"),
    L("<devices>"), L('<entry name="localhost.localdomain">'), L("<deviceconfig>"), L("<system>"), L("<hostname>[[name]]</hostname>", ("device.hostname", "[[name]]")),
    L("<ip-address>10.[[nat]].7.[[n]]</ip-address>", ("interfaces.name", "management"), ("interfaces.description", "dedicated management port"), ("interfaces.addresses", "10.[[nat]].7.[[n]]/24"), ("interfaces.zone", "management"), ("interfaces.shutdown", "false"), ("interfaces.is_mgmt", "true")),
    L("<netmask>255.255.255.0</netmask>"), L("<service>"), L("<disable-telnet>[[CASE WHEN q % 3 = 0 THEN 'no' ELSE 'yes' END]]</disable-telnet>", ("mgmt.telnet_enabled", TELNET)), L("<disable-http>yes</disable-http>", ("mgmt.http_enabled", "false")),
    L("<disable-ssh>no</disable-ssh>", ("mgmt.ssh.enabled", "true")), L("</service>"), L("<login-banner>keep out</login-banner>", ("mgmt.login_banner", "true")), L("<mystery>[[k]]</mystery>", claim=False), L("</system>"),
    L("<setting>"), L("<management>"), L("<idle-timeout>[[q % 30]]</idle-timeout>", ("mgmt.idle_timeout_min", "[[q % 30]]")), L("</management>"), L("</setting>"), L("</deviceconfig>"), L("</entry>"), L("</devices>"), L("</config>"),
]
#: Readings of whole files: path, value, condition, and the line that is cited.
NTP_OFF = lambda rest: ("ntp.authenticated", "false", rest, "{ntp}")
FOLDED = {
    "cisco": [
        ("mgmt.idle_timeout_min", "[[least(q % 30, 12)]]", "true", "CASE WHEN q % 30 <= 12 THEN {t1} ELSE {t2} END"), ("mgmt.telnet_enabled", TELNET, "true", "{tr1}"), NTP_OFF("q % 4 <> 0"),
        ("mgmt.mgmt_acl", "VTY", "q % 8 = 0", "{vty}"), ("mgmt.mgmt_acl", "MGMT", "q % 8 <> 0", "{acl_in}"),
    ],
    "arista": [("mgmt.idle_timeout_min", "[[q % 20]]", "true", "{idle}"), ("mgmt.telnet_enabled", TELNET, "true", "{telnet}"), NTP_OFF("q % 2 <> 0")],
    "juniper": [("mgmt.telnet_enabled", "false", "q % 3 <> 0", "{services}"), ("mgmt.http_enabled", "false", "true", "{services}"), NTP_OFF("q % 4 <> 0")],
    "fortinet": [NTP_OFF("q % 2 <> 0")],
    "mikrotik": [NTP_OFF("true")],
    "paloalto": [],
}
VENDORS = {"cisco": CISCO, "arista": ARISTA, "juniper": JUNIPER, "fortinet": FORTINET, "mikrotik": MIKROTIK, "paloalto": PALOALTO}
SHOW = "Cisco IOS Software, C3900 Software, Version 15.2(4)M,\ncisco ISR[[4000 + q]] (1RU) processor with 1G\nProcessor board ID FTX[[k]]\n"

#: A device's numbers, in both dialects; a fleet of all vendors deals devices out by k modulo 6.
NUMBERS = "s_suppkey AS k, s_nationkey AS nat, s_suppkey % 250 + 1 AS n, s_name AS name"


def text_of(vendor: str) -> Column:
    """The file's text."""
    lines = ", ".join(f"CASE WHEN {x.when} THEN {sql_text(x.text)} END" for x in VENDORS[vendor])
    return F.expr(f"array_join(filter(array({lines}), x -> x IS NOT NULL), '\\n') || '\\n'")


def devices(spark: SparkSession, sf_dir: str, shared: bool) -> DataFrame:
    """k, q, nat, n, name of every supplier, over all cores; ``shared``: q counts within a vendor."""
    q = "CAST(floor(s_suppkey / 6) AS BIGINT)" if shared else "s_suppkey"
    return spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(*NUMBERS.split(", "), f"{q} AS q"), "k")


def files(spark: SparkSession, sf_dir: str, vendor: str) -> DataFrame:
    """Source files of a fleet of one vendor."""
    return devices(spark, sf_dir, False).select(F.concat(F.lit("d"), F.col("k").cast("string")).alias("device_id"), F.lit("running").alias("file"), F.lit("config").alias("role"), text_of(vendor).alias("text"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files of a fleet of all vendors; Cisco devices have show output too."""
    rows = devices(spark, sf_dir, True)
    text = F.lit(None).cast("string")
    for v, vendor in enumerate(VENDORS):
        text = F.when(F.col("k") % 6 == v, text_of(vendor)).otherwise(text)
    ident = F.concat(F.lit("d"), F.col("k").cast("string")).alias("device_id")
    shows = rows.where("k % 6 = 0").select(ident, F.lit("show-version").alias("file"), F.lit("show_output").alias("role"), F.expr(sql_text(SHOW).replace("\n", "\\n")).alias("text"))
    return rows.select(ident, F.lit("running").alias("file"), F.lit("config").alias("role"), text.alias("text")).unionByName(shows)


# -- SQL ------------------------------------------------------------------------------------------


def _duck(expression: str) -> str:
    return expression.replace("AS STRING", "AS VARCHAR")


def lines_sql(vendor: str, source: str) -> str:
    """k, i, line_no, claimed of a vendor's devices in ``source``."""
    made = ", ".join(f"CASE WHEN {x.when} THEN {k} END" for k, x in enumerate(VENDORS[vendor]))
    silent = ", ".join(str(k) for k, x in enumerate(VENDORS[vendor]) if not x.claim)
    return f"SELECT k, '{vendor}' AS vendor, i, row_number() OVER (PARTITION BY k ORDER BY i) AS line_no, i NOT IN ({silent}) AS claimed FROM (SELECT k, unnest([{made}]) AS i FROM {source}) WHERE i IS NOT NULL"


def facts_sql(vendor: str, source: str) -> str:
    """k, line_no, path, value of a vendor's devices in ``source``."""
    tags = {x.tag: k for k, x in enumerate(VENDORS[vendor]) if x.tag}
    made = [(str(k), f[0], f[1], f[2] if len(f) > 2 else "true", "false") for k, x in enumerate(VENDORS[vendor]) for f in x.facts]
    made += [(at.format(**tags), path, value, cond, "true") for path, value, cond, at in FOLDED[vendor]]
    structs = ", ".join(f"{{'i': {i}, 'path': '{path}', 'value': {_duck(sql_text(value))}, 'ok': {cond}, 'late': {late}}}" for i, path, value, cond, late in made)
    return f"SELECT l.k, l.vendor, l.line_no, f.path AS path, f.value AS value, f.late AS late FROM (SELECT k, unnest([{structs}]) AS f FROM {source}) fk JOIN ({lines_sql(vendor, source)}) l ON l.k = fk.k AND l.i = f.i WHERE f.ok"


def contexts(vendor: str) -> list[list[str]]:
    """The headers around each line, as the list of lines nests them by its own indents or braces."""
    out: list[list[str]] = []
    open_: list[tuple[int, str]] = []
    for x in VENDORS[vendor]:
        text, indent = x.text.strip(), len(x.text) - len(x.text.lstrip())
        if vendor == "paloalto":
            out.append([])
        elif vendor == "mikrotik":
            out.append([] if text[0] == "#" else re.split(" (?:set|add) ", text, maxsplit=1)[:1])
        elif text[0] in "!#":
            out.append([])
            open_ = [] if text == "!" else open_
        elif vendor == "juniper":
            closing = text == "}"
            out.append([] if closing else [h for _, h in open_])
            open_ = open_[:-1] if closing else open_ + [(indent, text[:-2])] if text.endswith("{") else open_
        else:
            open_ = [o for o in open_ if o[0] < indent]
            closing = text in ("end", "next")
            out.append([] if closing else [h for _, h in open_])
            open_ = open_ if closing else open_ + [(indent, text)]
    return out


def contexts_sql(vendor: str, source: str) -> str:
    """k, line_no, context of a vendor's devices in ``source``."""
    structs = ", ".join(f"{{'i': {i}, 'context': {_duck(sql_text(' / '.join(c)))}}}" for i, c in enumerate(contexts(vendor)))
    return f"SELECT l.k, l.line_no, f.context AS context FROM (SELECT k, unnest([{structs}]) AS f FROM {source}) fk JOIN ({lines_sql(vendor, source)}) l ON l.k = fk.k AND l.i = f.i"


ONE = f"(SELECT {NUMBERS}, s_suppkey AS q FROM supplier)"


def _part(v: int) -> str:
    return f"(SELECT {NUMBERS}, s_suppkey // 6 AS q FROM supplier WHERE s_suppkey % 6 = {v})"


#: All lines and facts of the mixed fleet.
FLEET_LINES = " UNION ALL ".join(lines_sql(vendor, _part(v)) for v, vendor in enumerate(VENDORS))
FLEET_FACTS = " UNION ALL ".join(facts_sql(vendor, _part(v)) for v, vendor in enumerate(VENDORS))
FLEET_CONTEXTS = " UNION ALL ".join(contexts_sql(vendor, _part(v)) for v, vendor in enumerate(VENDORS))
