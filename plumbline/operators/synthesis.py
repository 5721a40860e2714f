"""From "this line sets that field" to a rule: token classes, polarity, the value's place, pattern and block.

All columns: a line becomes an array of tokens with their classes once, and each kind of field chooses the
token that holds its value.  What doesn't fit gives null, so that a line's next best field gets its turn.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.scalars import customer_data, is_data, transform

# Words that negate a command, pairs of truth words, keys that switch, keys of secrets and of
# names and addresses, verbs that are never values, and words between a community's keyword and its name.
NEGATIONS = ["no", "undo", "delete", "disable", "deactivate"]
PAIRS = [("enable", "disable"), ("enabled", "disabled"), ("yes", "no"), ("true", "false"), ("on", "off")]
SWITCHES = ["disabled", "disable", "enabled", "enable", "status", "state", "shutdown"]
SECRETS = ["password", "passwd", "secret", "key", "psk", "pre-shared-key", "auth-key", "priv-key"]
NAMES = ["name", "user", "username", "community", "address", "remote", "host", "server", "comment", "src-address", "dst-address", "interface", "default-name"]
VERBS = ["set", "add", "remove", "edit", "find", "print", "delete", "config", "next"]
MODIFIERS = ["read", "write", "ro", "rw", "cipher", "simple", "read-only", "read-write", "add", "set"]

_ADDRESS = r"^\d{1,3}(?:\.\d{1,3}){3}(?:/\d{1,2})?$|^(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}(?:/\d{1,3})?$"
_DOMAIN = r"^[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+){2,}$"
_TRUTH = {w: f"{a}|{b}" for a, b in PAIRS for w in (a, b)}

#: What each transform of the vocabulary means for the choice.
KINDS = {"to_bool": "bool", "presence": "bool", "to_int": "int", "identity": "name", "collect": "list", "collect_redacted": "community"}
TRANSFORMS = ["collect", "collect_redacted", "identity", "invert_yes_no", "negated_presence", "presence", "to_bool", "to_int"]


def tokens(text: Column) -> Column:
    """Tokens (raw, key, held, word, content, data) of a line without its closing semicolon.

    ``key`` and ``held`` are the sides of ``key=value``, and for other words null and the word itself."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.trim(text), r"[;\s]+$", "")), r"\s+"), lambda w: w != "")

    def token(w: Column) -> Column:
        pair = F.contains(w, F.lit("=")) & ~F.startswith(w, F.lit("="))
        held = F.when(pair, F.regexp_replace(w, "^[^=]*=", "")).otherwise(w)
        content = F.regexp_replace(held, "^[\"';]+|[\"';]+$", "")
        return F.struct(
            w.alias("raw"), F.when(pair, F.split_part(w, F.lit("="), F.lit(1))).alias("key"), held.alias("held"), F.lower(content).alias("word"), content.alias("content"), is_data(held).alias("data")
        )

    return F.transform(words, token)


def _places(t: Column) -> Column:
    return F.sequence(F.lit(0), F.size(t) - 1)


def _at(t: Column, i: Column | int) -> Column:
    return F.get(t, i if isinstance(i, Column) else F.lit(i))


def _first(t: Column, test) -> Column:
    """The first place after the first word whose token passes, null if none does."""
    return F.get(F.filter(_places(t), lambda i: (i > 0) & test(i)), F.lit(0))


def _key(t: Column, i: Column) -> Column:
    return F.lower(F.coalesce(_at(t, i)["key"], F.lit("")))


def secret(t: Column, i: Column) -> Column:
    """Whether a token is a credential or follows the word for one."""
    before = F.when(i > 0, _at(t, i - 1)["word"])
    return _key(t, i).isin(*SECRETS) | F.coalesce(before.isin(*SECRETS) | before.rlike("(password|secret|cipher)$"), F.lit(False))


def _choice(name: Column | str, at: Column, group: Column | str) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_column(name).alias("transform"), at.cast("int").alias("at"), as_column(group).alias("group"))


def _truth(t: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in _TRUTH.items() for x in kv))
    known = lambda i: _at(t, i)["word"].isin(*_TRUTH)
    keyed = F.get(F.filter(_places(t), lambda i: _key(t, i).isin(*SWITCHES) & known(i)), F.lit(0))
    bare = F.try_element_at(F.filter(_places(t), lambda i: (i > 0) & _at(t, i)["key"].isNull() & known(i)), F.lit(-1))
    group = lambda i: F.concat(F.lit("(?P<value>"), F.try_element_at(pairs, _at(t, i)["word"]), F.lit(")"))
    flips = F.exists(F.slice(t, F.lit(1), F.greatest(bare, F.lit(0))), lambda x: F.startswith(x["word"], F.lit("disable")))
    said = lambda inverted: F.when(inverted, "invert_yes_no").otherwise("to_bool")
    nowhere = F.lit(None)
    return (
        F.when(_at(t, 0)["word"].isin(*NEGATIONS) & (F.size(t) > 1), _choice("negated_presence", nowhere, ""))
        .when(keyed.isNotNull(), _choice(said(_key(t, keyed).rlike("^(disable|shutdown)")), keyed, group(keyed)))
        .when(bare.isNotNull(), _choice(said(flips), bare, group(bare)))
        .otherwise(_choice("presence", nowhere, ""))
    )


def _number(t: Column) -> Column:
    at = _first(t, lambda i: _at(t, i)["content"].rlike(r"^\d+$"))
    return F.when(at.isNotNull() & ~secret(t, at), _choice("to_int", at, r"(?P<value>\d+)"))


def _community(t: Column) -> Column:
    """Behind the word for a community, perhaps one modifier further on, or the value of its key."""
    word = lambda i: F.coalesce(_at(t, i)["word"], F.lit(""))
    plain = lambda i: ~word(i).isin(*MODIFIERS)
    named = lambda i, back: (i >= back) & F.contains(word(i - back), F.lit("community"))
    test = lambda i: _key(t, i).isin("name", "community") | (plain(i) & (named(i, 1) | (named(i, 2) & ~plain(i - 1))))
    return F.get(F.filter(_places(t), test), F.lit(0))


def _data(t: Column, kind: str) -> Column:
    address = _first(t, lambda i: _at(t, i)["content"].rlike(f"{_ADDRESS}|{_DOMAIN}"))
    if kind == "community":
        at = F.coalesce(_community(t), address)
    elif kind == "list":
        at = address
    else:
        named = F.get(F.filter(_places(t), lambda i: _key(t, i) == "name"), F.lit(0))
        last = F.filter(_places(t), lambda i: (i > 0) & _at(t, i)["key"].isNull() & ~_at(t, i)["word"].isin(*VERBS) & _at(t, i)["raw"].rlike("[\\p{L}\\p{N}]"))
        at = F.coalesce(address, named, F.try_element_at(last, F.lit(-1)))
    group = F.when(_at(t, at)["content"].rlike(_ADDRESS), r"(?P<value>[0-9A-Fa-f:./]+)").otherwise(r"(?P<value>[^\s;]+)")
    name = {"community": "collect_redacted", "list": "collect", "name": "identity"}[kind]
    return F.when((at > 0) & ~secret(t, at), _choice(name, at, group))


def chosen(kind: Column, t: Column) -> Column:
    """(transform, at, group) for a field of this kind, null if the line has no token of its shape."""
    some = F.size(t) > 0
    return (
        F.when(some & (kind == "bool"), _truth(t))
        .when(some & (kind == "int"), _number(t))
        .when(some & (kind == "community"), _data(t, "community"))
        .when(some & (kind == "list"), _data(t, "list"))
        .when(some & (kind == "name"), _data(t, "name"))
    )


def literal(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.^$|?*+()\[\]{}])", r"\\$1")


def pattern(text: Column, t: Column, choice: Column) -> Column:
    """The line with its value as a group and its other data left open; keys stay, secrets and names never."""

    def part(w: Column, i: Column) -> Column:
        here = F.coalesce(i == choice["at"], F.lit(False))
        open_ = F.lower(w["key"]).isin(*SECRETS, *NAMES) | w["data"]
        pair = F.concat(literal(w["key"]), F.lit("="), F.when(here, choice["group"]).when(open_, r"\S+").otherwise(literal(w["held"])))
        return F.when(w["key"].isNotNull(), pair).when(here, choice["group"]).when(w["data"], r"\S+").otherwise(literal(w["raw"]))

    end = F.when(F.rtrim(text).rlike(r";\s*$"), r"\s*;?$").otherwise("$")
    return F.concat(F.lit("^"), F.array_join(F.transform(t, part), r"\s+"), end)


def within(context: Column) -> Column:
    """The first two grammar words of the nearest header, as a pattern; null without one."""
    words = F.filter(F.split(F.trim(F.try_element_at(context, F.lit(-1))), r"\s+"), lambda w: (w != "") & ~is_data(w))
    first = F.slice(words, F.lit(1), F.lit(2))
    return F.when(F.size(first) > 0, F.concat(F.lit("^"), F.array_join(F.transform(first, literal), r"\s+"), F.lit(r"\b")))


def value_of(t: Column, choice: Column) -> Column:
    """What the rule makes of its own line, null if its group or its transform refuses the token."""
    held = _at(t, choice["at"])["held"]
    fits = choice["at"].isNull() | F.coalesce(F.regexp_like(held, F.concat(F.lit("^"), F.replace(choice["group"], F.lit("?P<"), F.lit("?<")), F.lit("$"))), F.lit(False))
    out = F.lit(None).cast("string")
    for name in TRANSFORMS:
        out = F.when(choice["transform"] == name, transform(name, held)).otherwise(out)
    return F.when(fits, out)


def publishable(made: Column) -> Column:
    """Whether a pattern shows nothing of a customer, as it stands and without its escapes."""
    plain = F.regexp_replace(made, r"\(\?P<\w+>", "(")
    return made.isNull() | (customer_data(plain).isNull() & customer_data(F.regexp_replace(plain, r"\\(?=[.$+/*?()\[\]{}|^-])", "")).isNull())
