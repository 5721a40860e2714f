"""Scalar functions on strings, masks and secrets, as columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "<redacted>"

#: Fixed: what stands before a secret (kept), and the secret, in the order in which they apply.
SECRETS = [
    r"(?i)(\bsecret\s+\d\s+)(\S+)",
    r"(?i)(\bpassword\s+\d\s+)(\S+)",
    r"(?i)(\bsecret\s+)(?!\d\s)(\S+)",
    r"(?i)(\bpassword\s+)(?!\d\s)(\S+)",
    r"(?i)(\bsnmp-server\s+community\s+)(\S+)",
    r"(?i)(\bcommunity\b.*?\bname=)(\S+)",
    r"(?i)(\bname=)(\S+)(?=.*\bcommunity)",
    r"(?i)(\bcommunity\s+(?:(?:add|set|read|write|ro|rw|read-only|read-write|cipher|simple)\s+)*)(?!name=|(?:add|set|read|write|ro|rw|read-only|read-write|cipher|simple)\s)([^\s=]+)(?=\s|$)",
    r"(?i)(^|\s)(\$\d+[a-z]?\$\S+)",
    r"(?i)(\bcipher\s+)(\S+)",
    r"(%\^%#)(\S+?)(?=%\^%#)",
    r"(?i)(\bkey\s+\d\s+)(\S+)",
    r"(?i)(\bpre-shared-key\s+)(\S+)",
    r"(?i)(\bauthentication-key\s+)(\S+)",
    r"(?i)(\bencrypted-password\s+)(\S+)",
    r"(?i)(\bplain-text-password\s+)(\S+)",
    r"(?i)(\bset\s+passwd\s+)(\S+)",
    r"(?i)(\bset\s+psksecret\s+)(\S+)",
    r"(?i)(\bpassword=)(\S+)",
    r"(?i)(\bsecret=)(\S+)",
    r"(?i)(\bpsk=)(\S+)",
    r"(?i)(\bkey=)(\S+)",
]
#: What every line that a pattern meets holds: a quick test before the patterns.
HINT = r"(?i)secret|passw|community|\$\d|cipher|%\^%#|key|psk"
#: Fixed: hash algorithms by type number and by prefix.
BY_TYPE = {"0": "plaintext", "4": "sha256", "5": "md5", "7": "reversible", "8": "pbkdf2", "9": "scrypt"}
BY_PREFIX = {"$1$": "md5", "$5$": "sha256", "$6$": "sha512", "$8$": "pbkdf2", "$9$": "scrypt", "$2a$": "bcrypt", "$2b$": "bcrypt", "$2y$": "bcrypt"}
#: Fixed: words that a truth value is read from, and communities that everybody tries first.
TRUE = ["yes", "true", "enable", "enabled", "on", "1", "y"]
FALSE = ["no", "false", "disable", "disabled", "off", "0", "n"]
COMMUNITIES = ["public", "private", "community", "admin", "default", "cisco", "manager", "snmp", "secret"]
#: Fixed: port names.
PORTS = {"ssh": 22, "telnet": 23, "http": 80, "www": 80, "https": 443, "snmp": 161}
#: Fixed: detectors of customer data, in order.
DETECTORS = [
    ("an IPv4 address", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"),
    ("an IPv6 address", r"(?i)\b(?:[0-9a-f]{1,4}:){3,7}[0-9a-f]{1,4}\b"),
    ("an email address", r"[\w.+-]+@[\w-]+\.[\w.-]+"),
    ("a hostname", r"(?i)\b[a-z0-9-]+(?:\.[a-z0-9-]+){2,}\b"),
    ("a credential hash", r"\$\d\$"),
    ("a credential-shaped literal", r"(?<![\w\\])[A-Za-z0-9+/$]{24,}"),
]


def redact(line: Column) -> Column:
    """A line with its secrets replaced; everything else stays in place."""
    clean = line
    for pattern in SECRETS:
        clean = F.regexp_replace(clean, pattern, "$1" + MARK)
    # most lines hold none of the words that a pattern needs
    return F.when(line.rlike(HINT), clean).otherwise(line)


def redact_literal(line: Column, secret: Column) -> Column:
    """A line without a known secret of two or more characters, quotes aside."""
    bare = F.trim(F.translate(secret, "\"'", ""))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) >= 2, F.replace(line, bare, F.lit(MARK))).otherwise(line)


def hash_algorithm(secret: Column, kind: Column) -> Column:
    """The algorithm behind a stored secret: by its type number if there is one, else by its prefix."""
    by_type: Column = F.lit(None).cast("string")
    for k, v in BY_TYPE.items():
        by_type = F.when(F.trim(kind) == k, v).otherwise(by_type)
    by_prefix: Column = F.lit(None).cast("string")
    for k, v in BY_PREFIX.items():
        by_prefix = F.when(F.startswith(F.trim(secret), F.lit(k)), v).otherwise(by_prefix)
    return F.when(F.coalesce(kind, F.lit("")) != "", by_type).otherwise(by_prefix)


def community_marker(value: Column, known: list[str]) -> Column:
    return F.when(F.lower(value).isin(*known), "default").otherwise("custom")


def ipv4_number(text: Column) -> Column:
    """A dotted address as a number; null if it is none."""
    p = [F.try_to_number(F.regexp_extract(text, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i), F.lit("999")).cast("long") for i in range(1, 5)]
    good = text.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(good, ((p[0] * 256 + p[1]) * 256 + p[2]) * 256 + p[3])


def address_digits(text: Column) -> Column:
    """An address as hex digits, 8 of IPv4 and 32 of IPv6; null if it is none."""
    v4 = F.lpad(F.lower(F.hex(ipv4_number(text))), 8, "0")
    low = F.lower(text)
    halves = F.split(low, "::")
    groups = lambda t: F.filter(F.split(t, ":"), lambda x: x != "")
    left, right = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    lost = F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0))
    whole = F.concat(left, F.array_repeat(F.lit("0"), lost), right)
    short = F.contains(low, F.lit("::"))
    good = low.rlike("^[0-9a-f:]*$") & (F.size(halves) <= 2) & (F.size(whole) == 8) & F.when(short, lost > 0).otherwise(low.rlike("^[^:]+(:[^:]+){7}$")) & ~F.exists(whole, lambda g: F.length(g) > 4) & ~low.rlike("^:[^:]|[^:]:$")
    return F.when(F.contains(text, F.lit(":")), F.when(good, F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))).otherwise(v4)


def leading_bits(digits: Column, length: Column) -> Column:
    """The first ``length`` bits of an address as hex digits, the last one filled with zeros."""
    rest = length % 4
    nibble = F.conv(F.substring(digits, F.floor(length / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    part = F.lower(F.hex(nibble - nibble % F.pow(F.lit(2.0), 4 - rest).cast("int")))
    return F.concat(F.left(digits, F.floor(length / 4).cast("int")), F.when(rest > 0, F.coalesce(part, F.lit(""))).otherwise(""))


def digits_address(digits: Column) -> Column:
    """The usual text of an address: dotted, or groups with the first longest run of zero groups left out."""
    pair = lambda k: F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10)
    v4 = F.concat_ws(".", *(pair(k) for k in range(4)))
    groups = F.concat_ws(":", *(F.lower(F.conv(F.substring(digits, 4 * k + 1, 4), 16, 16)) for k in range(8)))
    v6 = groups
    for n in range(2, 9):  # the longest run wins, so it is tried last and stands outermost
        run = f"^(|.*?:)0(?::0){{{n - 1}}}(|:.*)$"
        v6 = F.when(groups.rlike(run), F.concat(F.regexp_replace(F.regexp_extract(groups, run, 1), ":$", ""), F.lit("::"), F.regexp_replace(F.regexp_extract(groups, run, 2), "^:", ""))).otherwise(v6)
    return F.when(F.length(digits) == 8, v4).otherwise(v6)


def mask_prefix(mask: Column) -> Column:
    """Prefix length of a contiguous netmask; null for others."""
    n = ipv4_number(mask)
    bits = F.bit_count(n).cast("int")
    return F.when(n == (F.lit(1 << 32) - F.pow(F.lit(2.0), F.lit(32) - bits)).cast("long"), bits)


def wildcard_prefix(wildcard: Column) -> Column:
    """A wildcard's set bits taken from 32: an inverted mask; 32 if it can't be read."""
    return F.coalesce(F.lit(32) - F.bit_count(ipv4_number(wildcard)).cast("int"), F.lit(32))


def to_bool(text: Column) -> Column:
    low = F.lower(F.regexp_replace(F.trim(text), '^"+|"+$', ""))
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)


def port_number(word: Column) -> Column:
    out = F.coalesce(F.when(word.rlike(r"^\d+$"), word.try_cast("int")), F.lit(-1))
    for k, v in PORTS.items():
        out = F.when(word == k, v).otherwise(out)
    return out


def port_matches(expression: Column, port: Column) -> Column:
    """Whether ``eq x`` or ``low-high`` holds for a port."""
    text = F.lower(F.trim(expression))
    one = port_number(F.trim(F.substring(text, 4, 1000))) == port
    low, high = port_number(F.trim(F.split_part(text, F.lit("-"), F.lit(1)))), port_number(F.trim(F.regexp_replace(text, "^[^-]*-", "")))
    return F.when(F.startswith(text, F.lit("eq ")), one).when(F.contains(text, F.lit("-")), (low <= port) & (port <= high)).otherwise(False)


def is_data(word: Column) -> Column:
    """Words that carry data rather than grammar."""
    core = F.regexp_replace(word, "^[\"';,]+|[\"';,]+$", "")
    return (
        F.startswith(word, F.lit("$"))
        | word.rlike("^[\"']")
        | core.rlike(r"^\d+$|^(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}(?:/\d{1,3})?$|^[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+){2,}$")
        | (core.rlike(r"\d") & (F.length(core) > 1))
        | customer_data(core).isNotNull()
    )


def line_shape(text: Column) -> Column:
    """The family of a line: grammar words in lower case, data as ``*``, keys of pairs kept."""
    word = lambda w: F.when(F.contains(w, F.lit("=")), F.concat(F.split_part(w, F.lit("="), F.lit(1)), F.lit("=*"))).when(is_data(w), "*").otherwise(F.lower(w))
    return F.array_join(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), word), " ")


def customer_data(text: Column) -> Column:
    """The first kind of customer data that a text shows; null if none."""
    out: Column = F.lit(None).cast("string")
    for name, pattern in reversed(DETECTORS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def transform(name: str, value: Column, table: dict[str, str] | None = None) -> Column:
    """The value that a learned mapping writes, as text; null where the transform fails."""
    bare = F.regexp_replace(F.trim(value), '^"+|"+$', "")
    number = F.when(bare.rlike(r"^[+-]?\d+$"), bare.try_cast("int"))
    flag = to_bool(bare)
    if name in ("identity", "collect"):
        return bare
    if name == "to_int":
        return number.cast("string")
    if name == "to_bool":
        return flag.cast("string")
    if name == "invert_yes_no":
        return (~flag).cast("string")
    if name == "minutes_from_seconds":
        return F.ceil(number / 60).cast("string")
    if name == "presence":
        return F.lit("true")
    if name == "negated_presence":
        return F.lit("false")
    if name == "collect_redacted":
        return community_marker(bare, COMMUNITIES)
    if name == "lookup":
        out: Column = F.lit(None).cast("string")
        for k, v in (table or {}).items():
            out = F.when(F.lower(bare) == k.lower(), F.lit(str(v))).otherwise(out)
        return out
    raise ValueError(f"unknown transform {name!r}")


#: Fixed: the transforms of learned mappings.
TRANSFORMS = ("identity", "collect", "to_int", "to_bool", "invert_yes_no", "minutes_from_seconds", "presence", "negated_presence", "collect_redacted", "lookup")


def transform_named(name: Column, value: Column, table: Column) -> Column:
    """``transform`` where the transform's name and its table (keys in lower case) are columns."""
    bare = F.regexp_replace(F.trim(value), '^"+|"+$', "")
    out: Column = F.lit(None).cast("string")
    for known in TRANSFORMS:
        made = F.try_element_at(table, F.lower(bare)) if known == "lookup" else transform(known, value)
        out = F.when(name == known, made).otherwise(out)
    return out


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in lower-case hex, composed of two hashes with pads made on the driver."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def credential_fingerprint(key: bytes, secret: Column) -> Column:
    return F.left(hmac_sha256(key, secret), F.lit(32))


def leaf_hash(json: Column) -> Column:
    """SHA-256 of a leaf: a zero byte, then the canonical text."""
    return F.sha2(F.concat(F.lit(b"\x00"), json.cast("binary")), 256)
