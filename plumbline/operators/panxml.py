"""PAN-OS documents: facts and read lines from one pass of an XML parser that knows its line numbers."""

from __future__ import annotations

import xml.parsers.expat
from collections.abc import Iterator

import pandas as pd

#: Fixed: communities that a vendor's devices are shipped with.
SHIPPED = {
    "cisco": ["public", "private", "cisco", "admin", "secret", "community"],
    "juniper": ["public", "private", "juniper", "admin"],
    "fortinet": ["public", "private", "fortinet", "admin"],
    "mikrotik": ["public", "private", "mikrotik", "admin"],
    "paloalto": ["public", "private", "community", "admin", "default", "paloalto"],
}

#: Leaves of a PAN-OS document: path of tags -> (fact, kind of reading).
_PAN = "config/devices/entry/deviceconfig/system/"
LEAVES = {
    _PAN + "hostname": ("device.hostname", "text"),
    _PAN + "service/disable-telnet": ("mgmt.telnet_enabled", "not"),
    _PAN + "service/disable-http": ("mgmt.http_enabled", "not"),
    _PAN + "service/disable-https": ("mgmt.https_enabled", "not"),
    _PAN + "service/disable-ssh": ("mgmt.ssh.enabled", "not"),
    _PAN + "login-banner": ("mgmt.login_banner", "any"),
    _PAN + "snmp-setting/access-setting/version/v2c/snmp-community-string": ("snmp.communities", "community"),
    "config/devices/entry/deviceconfig/setting/management/idle-timeout": ("mgmt.idle_timeout_min", "number"),
    "config/mgt-config/password-complexity/enabled": ("aaa.password_policy.complexity", "yes"),
    "config/mgt-config/password-complexity/minimum-length": ("aaa.password_policy.min_length", "number"),
    "config/shared/log-settings/syslog/entry/server/entry/server": ("logging.servers", "append"),
}
_YES = {"yes": True, "no": False}


def _contiguous(mask: str) -> int | None:
    parts = mask.strip().split(".")
    if len(parts) != 4 or not all(p.isdigit() and int(p) < 256 for p in parts):
        return None
    bits = "".join(format(int(p), "08b") for p in parts)
    return None if "01" in bits else bits.count("1")


class PanReader:
    """Writes facts while the document is read; what must wait for siblings is kept until the end."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.read: set[int] = set()
        self.claims: set[int] = set()
        self.open: list[list] = []  # tag, name, line, text, lines of children
        self.ntp: list[bool] = []
        self.kinds: list[str] = []
        self.late: list[tuple[int, int]] = []
        self.port: dict[str, tuple[str, int]] = {}
        self.zones: dict[str, str] = {}
        self.ethernet: list[tuple[str, int, list, str | None]] = []
        self.error: str | None = None

    def write(self, line: int, path: str, value: str | None, op: str = "set", entity: int | None = None, secret: str | None = None) -> None:
        self.rows.append((line, len(self.rows), path, op, entity, value, secret))
        self.read.add(line)

    def run(self, text: str) -> None:
        parser = xml.parsers.expat.ParserCreate()

        def refuse(*_: object) -> None:
            raise ValueError("a document type is refused")

        def start(tag: str, attributes: dict) -> None:
            if self.open:
                self.open[-1][4].append(parser.CurrentLineNumber)
            self.open.append([tag, attributes.get("name"), parser.CurrentLineNumber, "", []])

        def end(_: str) -> None:
            self.close(parser.CurrentLineNumber)

        def data(chunk: str) -> None:
            self.open[-1][3] += chunk

        parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = refuse
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
        try:
            parser.Parse(text, True)
        except (ValueError, xml.parsers.expat.ExpatError) as e:
            self.error = str(e)
            self.rows = []
            return
        self.finish(text)

    def close(self, last: int) -> None:
        tag, name, line, raw, children = self.open.pop()
        value = raw.strip()
        tags = [o[0] for o in self.open] + [tag]
        path = "/".join(tags)
        leaf = LEAVES.get(path)
        if leaf:
            where, kind = leaf
            if kind == "text" and value or kind == "number" and value.isdigit():
                self.write(line, where, value)
            elif kind == "append" and value:
                self.write(line, where, value, "append")
            elif kind == "any":
                self.write(line, where, str(bool(value)).lower())
            elif kind in ("not", "yes") and value.lower() in _YES:
                self.write(line, where, str(_YES[value.lower()] ^ (kind == "not")).lower())
            elif kind == "community" and value:
                self.write(line, where, "default" if value.lower() in SHIPPED["paloalto"] else "custom", "append", secret=value)
                self.write(line, "snmp.version", "2", secret=value)
        elif path in (_PAN + "ip-address", _PAN + "netmask") and value:
            self.port[tag] = (value, line)
        elif path == _PAN + "permitted-ip/entry":
            self.port.setdefault("permitted", ("", self.open[-1][2]))
        elif path == _PAN + "snmp-setting/access-setting/version/v3":
            if not any(r[2] == "snmp.communities" for r in self.rows):
                self.write(line, "snmp.version", "3")
        elif path.startswith(_PAN + "ntp-servers/"):
            if tag == "ntp-server-address" and value:
                self.write(line, "ntp.servers", value, "append")
            elif tags[-2] == "authentication-type":
                self.kinds.append(tag)
                self.read.add(line)
            elif tag == "authentication-type":
                self.ntp.append(bool(self.kinds) and "none" not in self.kinds)
                self.kinds = []
                self.port["ntp"] = ("", line)
        elif path == "config/mgt-config/users/entry/phash" and value:
            self.port["phash"] = (value, line)
        elif path == "config/mgt-config/users/entry/permissions/role-based/superuser":
            self.port["superuser"] = (value, line)
        elif path == "config/mgt-config/users/entry":
            superuser = self.port.pop("superuser", None)
            phash = self.port.pop("phash", None)
            self.write(line, "aaa.local_users.name", name or "", entity=line)
            self.write(line, "aaa.local_users.privilege", "15" if superuser and superuser[0].lower() == "yes" else "1", entity=line)
            if superuser:
                self.read.add(superuser[1])
            if phash:
                kind = next((v for k, v in _PREFIXES.items() if phash[0].startswith(k)), None)
                self.write(phash[1], "aaa.local_users.hash", kind, entity=line, secret=phash[0])
        elif path == "config/devices/entry/vsys/entry/zone/entry/network/layer3/member":
            zone = next((o[1] for o in self.open[::-1] if o[0] == "entry"), None)
            self.zones[value] = zone or ""
            self.read.add(line)
        elif path == "config/devices/entry/network/interface/ethernet/entry/layer3/ip/entry" and name:
            self.port["addresses"] = (self.port.get("addresses", ("", 0))[0] + " " + name, line)
            self.read.add(line)
        elif path == "config/devices/entry/network/interface/ethernet/entry/comment":
            self.port["comment"] = (value, line)
            self.read.add(line)
        elif path == "config/devices/entry/network/interface/ethernet/entry":
            self.ethernet.append((name or "", line, self.port.pop("addresses", ("", 0))[0].split(), self.port.pop("comment", (None, 0))[0]))
            self.read.add(line)
        several = [c for c in children if c != line]
        if several:
            self.claims.update((line, last))
        else:
            self.claims.update(x for x in (line, last) if line in self.read)
            self.late.append((line, last))

    def finish(self, text: str) -> None:
        if "ip-address" in self.port:
            address, line = self.port["ip-address"]
            mask = self.port.get("netmask")
            prefix = _contiguous(mask[0]) if mask else None
            for field, value in (("name", "management"), ("description", "dedicated management port"), ("addresses", address if prefix is None else f"{address}/{prefix}"), ("zone", "management"), ("shutdown", "false"), ("is_mgmt", "true")):
                self.write(line, f"interfaces.{field}", value, entity=line)
            if mask and prefix is not None:
                self.read.add(mask[1])
        if "permitted" in self.port:
            self.write(self.port["permitted"][1], "mgmt.mgmt_acl", "permitted-ip")
        if self.ntp:
            self.write(self.port["ntp"][1], "ntp.authenticated", str(all(self.ntp)).lower())
        for name, line, addresses, about in self.ethernet:
            self.write(line, "interfaces.name", name, entity=line)
            for a in addresses:
                self.write(line, "interfaces.addresses", a, entity=line)
            if about is not None:
                self.write(line, "interfaces.description", about, entity=line)
            if name in self.zones:
                self.write(line, "interfaces.acl_in", f"zone-policy:{self.zones[name]}", entity=line)
                self.write(line, "interfaces.zone", self.zones[name], entity=line)
            self.write(line, "interfaces.shutdown", "false", entity=line)
            self.write(line, "interfaces.is_mgmt", "false", entity=line)
        self.claims.update(k for k, raw in enumerate(text.splitlines(), 1) if not raw.strip() or raw.strip().startswith(("<?xml", "<!--")))
        self.claims.update(x for line, last in self.late if line in self.read for x in (line, last))


_PREFIXES = {"$1$": "md5", "$5$": "sha256", "$6$": "sha512", "$8$": "pbkdf2", "$9$": "scrypt", "$2a$": "bcrypt", "$2b$": "bcrypt", "$2y$": "bcrypt"}


COLUMNS = ["device_id", "file", "line_no", "sub", "path", "op", "entity", "value", "secret", "claim"]
#: Files whose facts are handed on together.
FILES = 500


def rows_of(device: str, file: str, text: str) -> list[tuple]:
    """Facts and read lines of one document, or its error."""
    reader = PanReader()
    reader.run(text)
    rows = [(device, file, n, sub, path, op, entity, value, secret, n in reader.claims) for n, sub, path, op, entity, value, secret in reader.rows]
    rows += [(device, file, n, 0, None, None, None, None, None, True) for n in sorted(reader.claims)]
    if reader.error:
        rows.append((device, file, 1, 0, "~error", "set", None, reader.error, None, False))
    return rows


def read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Facts of documents (device_id, file, text), of many files at a time."""
    for batch in batches:
        for i in range(0, len(batch), FILES):
            part = batch.iloc[i : i + FILES]
            rows = [r for one in zip(part["device_id"], part["file"], part["text"], strict=True) for r in rows_of(*one)]
            yield pd.DataFrame(rows, columns=COLUMNS).astype({"entity": "Int32", "line_no": "int32", "sub": "int32"})
