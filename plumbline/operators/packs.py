"""Learned extraction: mappings that read lines which no grammar claimed, and structural lines.

A pack is data.  Its mappings are tried in their order on each unread line; the first whose pattern and
block match and whose transform succeeds writes the fact.  A failed transform leaves the line to the
next mapping.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.ed25519 import SigningKey, verify_all
from plumbline.functions.scalars import DETECTORS, TRANSFORMS, transform, transform_named
from plumbline.operators.anchors import keys_of, text_keys
from plumbline.operators.documents import SCALARS
from plumbline.operators.ledger import canonical
from plumbline.operators.structure import CLOSERS, COMMENTS, grammar, tree  # noqa: F401

LONGEST = 400
#: Up to so many mappings are tried as one conditional; an index of up to so many bytes is broadcast.
FEW, INDEX_BYTES = 64, 64 << 20


class PackError(ValueError):
    """A pack that isn't trusted or not well formed."""


@dataclass(frozen=True)
class Mapping:
    path: str
    match: str
    transform: str
    tier: int = 2
    confidence: float = 1.0
    within: str | None = None
    values: dict[str, str] = field(default_factory=dict, hash=False)

    def check(self) -> None:
        if self.path not in SCALARS and not self.path.startswith("device."):
            raise PackError(f"{self.path} can't be learned")
        for p in filter(None, (self.match, self.within)):
            safe_pattern(p)
            no_customer_data(p)
        for text in (x for kv in self.values.items() for x in kv):
            no_customer_data(str(text))
        if self.transform not in TRANSFORMS:
            raise PackError(f"unknown transform {self.transform!r}")


@dataclass(frozen=True)
class Pack:
    id: str
    vendor: str
    os: str | None
    mappings: tuple[Mapping, ...]
    fingerprint: tuple[tuple[str, float], ...] = ()
    signature: tuple[str, str] | None = field(default=None, compare=False)  # key id, base64

    def material(self) -> bytes:
        """What a signature covers; confidences as text of four places."""
        body = {"id": self.id, "vendor": self.vendor, "os": self.os or "", "mappings": [{"path": m.path, "match": m.match, "transform": m.transform, "tier": m.tier, "within": m.within or "", "confidence": f"{m.confidence:.4f}", "values": dict(m.values)} for m in self.mappings], "fingerprint": [[p, f"{c:.4f}"] for p, c in self.fingerprint]}
        return canonical(body)

    def digest(self) -> str:
        return hashlib.sha256(self.material()).hexdigest()

    def signed(self, key: SigningKey) -> Pack:
        """The same pack with a signature of its material; what is not well formed isn't signed."""
        for m in self.mappings:
            m.check()
        return replace(self, signature=(key.key_id, base64.b64encode(key.sign(self.material())).decode()))

    def signed_by(self, keys: dict[str, bytes]) -> str:
        """The id of the trusted key that signed the pack; anything else is refused."""
        if self.signature is None:
            raise PackError(f"{self.id} isn't signed")
        name, value = self.signature
        if name not in keys:
            raise PackError(f"{self.id} is signed by {name or 'a key without a name'}, which isn't trusted")
        try:
            raw = base64.b64decode(value, validate=True)
        except ValueError as e:
            raise PackError(f"{self.id} has a malformed signature") from e
        if not verify_all([self.material()], [raw], [keys[name]])[0]:
            raise PackError(f"{self.id} was altered after it was signed")
        return name


def document(pack: Pack) -> dict:
    """A pack as a plain document, for a JSON or YAML file."""
    own = {"signature": {"algorithm": "ed25519", "key_id": pack.signature[0], "value": pack.signature[1]}} if pack.signature else {}
    return own | {
        "id": pack.id, "vendor": pack.vendor, "os": pack.os, "fingerprint": [{"match": p, "confidence": c} for p, c in pack.fingerprint],
        "mappings": [{"ir_path": m.path, "match": m.match, "transform": m.transform, "tier_learned": m.tier, "confidence": m.confidence, "within": m.within, "values": dict(m.values)} for m in pack.mappings],
    }


def from_document(raw: dict) -> Pack:
    """The pack of a parsed document; what lacks a field is refused."""
    try:
        made = tuple(Mapping(m["ir_path"], m["match"], m["transform"], int(m.get("tier_learned", 2)), float(1.0 if m.get("confidence") is None else m["confidence"]), m.get("within"), dict(m.get("values") or {})) for m in raw["mappings"])
        s = raw.get("signature")
        if s and s.get("algorithm") != "ed25519":
            raise PackError("a signature of an unknown kind")
        signature = (str(s.get("key_id", "")), str(s.get("value", ""))) if s else None
        return Pack(raw["id"], raw["vendor"], raw.get("os"), made, tuple((f["match"], float(f["confidence"])) for f in raw.get("fingerprint") or ()), signature)
    except (KeyError, TypeError) as e:
        raise PackError(f"a pack lacks {e}") from e


def safe_pattern(pattern: str) -> None:
    """Refuses patterns that are long, malformed or repeat a repetition."""
    if len(pattern) > LONGEST:
        raise PackError("a pattern is too long")
    if re.search(r"\([^()]*[+*][^()]*\)[+*{]", pattern):
        raise PackError("a pattern repeats a repetition")
    try:
        re.compile(pattern)
    except re.error as e:
        raise PackError(f"malformed pattern: {e}") from e


def no_customer_data(pattern: str) -> None:
    """Refuses patterns and values that show an address, a name or a secret of somebody's."""
    plain = re.sub(r"\(\?P<\w+>", "(", pattern)
    for form in (plain, re.sub(r"\\(?=[.$+/*?()\[\]{}|^-])", "", plain)):
        for name, detector in DETECTORS:
            if re.search(detector, form):
                raise PackError(f"a pattern holds {name}")


def refusals(patterns: Column) -> Column:
    """Why each pattern of a column is refused; null for those that aren't, and for null."""

    @F.pandas_udf("string")
    def why(texts: pd.Series) -> pd.Series:
        return texts.map(_refusal)

    return why(patterns)


def _refusal(pattern: str | None) -> str | None:
    if pattern is None:
        return None
    try:
        safe_pattern(pattern)
        no_customer_data(pattern)
    except PackError as e:
        return str(e)
    return None


def checked(files: DataFrame, trusted: set[str], keys: dict[str, bytes] | None = None) -> DataFrame:
    """file, id, digest, admitted, problem of packs in JSON (file, text), each checked by executors as ``admit`` does.

    Null and empty texts, bad JSON and packs that lack a field are told as ``problem`` and leave the others alone."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, text in zip(batch["file"], batch["text"], strict=True):
                pack, problem = None, None
                try:
                    raw = json.loads(text or "")
                    if not isinstance(raw, dict):
                        raise PackError("a pack is a mapping")
                    pack = from_document(raw)
                    admit([pack], trusted, keys)
                except ValueError as e:  # also PackError and bad JSON
                    problem = str(e)
                rows.append((file, pack and pack.id, pack and pack.digest(), problem is None, problem))
            yield pd.DataFrame(rows, columns=["file", "id", "digest", "admitted", "problem"])

    return files.select("file", "text").mapInPandas(read, "file string, id string, digest string, admitted boolean, problem string")


def admit(packs: list[Pack], trusted: set[str], keys: dict[str, bytes] | None = None) -> list[Pack]:
    """All packs, if every one of them has a trusted digest or, where keys are given, is signed by one of them;
    none otherwise.  A signature that is there must hold even if the digest is trusted."""
    for p in packs:
        if keys is not None and (p.signature is not None or p.digest() not in trusted):
            p.signed_by(keys)
        elif p.digest() not in trusted:
            raise PackError(f"{p.id} isn't trusted")
        for m in p.mappings:
            m.check()
    return packs


def named(files: DataFrame, packs: list[Pack], least: float = 0.6) -> DataFrame:
    """device_id, vendor, os of devices that a pack's fingerprint names: confidences add up to one at most."""
    made = [F.struct(F.least(sum((F.when(F.col("text").rlike("(?m)" + p), c).otherwise(0.0) for p, c in k.fingerprint), F.lit(0.0)), F.lit(1.0)).alias("score"), F.lit(-i).alias("order"), F.lit(k.vendor).alias("vendor"), F.lit(k.os).alias("os")) for i, k in enumerate(packs)]
    if not made:
        return files.select("device_id", F.lit("").alias("vendor"), F.lit("").alias("os")).limit(0)
    best = files.where("role = 'config'").groupBy("device_id").agg(F.max(F.array_max(F.array(*made))).alias("b"))
    return best.where(F.col("b.score") >= least).select("device_id", "b.vendor", "b.os")


def _java(pattern: str) -> str:
    return pattern.replace("(?P<", "(?<")


def with_context(lines: DataFrame) -> DataFrame:
    """Lines with the headers of all blocks around them, if they don't have these yet."""
    return lines if "context" in lines.columns else tree(lines)


def matched(m: Mapping) -> tuple[Column, Column]:
    """Whether a mapping matches a line (text, context), and the value it makes of it, null if it can't.

    Its block may be any of those around the line."""
    hit = F.col("text").rlike(_java(m.match))
    if m.within:
        hit = hit & F.coalesce(F.exists("context", lambda h: h.rlike(_java(m.within))), F.lit(False))
    group = re.compile(m.match).groupindex.get("value")
    raw = F.regexp_extract("text", _java(m.match), group) if group else F.lit("")
    return hit, transform(m.transform, raw, dict(m.values))


def apply(residue: DataFrame, devices: DataFrame, packs: list[Pack]) -> DataFrame:
    """Facts of the lines that mappings read; booleans that a line asserts stay true.

    Blocks are known whose headers are among ``residue``, or all, if it has the column ``context``.  Up to ``FEW``
    mappings are one conditional; more are a table that lines meet by words (``first_by_index``), with the same facts
    and a plan that doesn't grow with them."""
    rows = with_context(residue).where("text <> ''").join(devices.select("device_id", "vendor", "os"), "device_id")
    found = first_by_index(rows, packs) if sum(len(p.mappings) for p in packs) > FEW else first_in_turn(rows, packs)
    # a later false gives way to a true of the same file
    once = F.max((F.col("f.value") == "true").cast("int")).over(W.partitionBy("device_id", "file", "f.path").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1))
    boolean = F.col("f.path").isin(*[k for k, v in SCALARS.items() if v == "boolean"])
    sticky = boolean & (F.col("f.value") == "false") & (F.coalesce(once, F.lit(0)) == 1)
    return found.withColumn("sticky", sticky).select(
        "device_id", "file", "line_no", F.lit(0).alias("sub"), F.when(~F.col("sticky"), F.col("f.path")).alias("path"), "f.op", F.lit(None).cast("int").alias("entity"), "f.value", F.lit(None).cast("string").alias("secret"), F.lit(True).alias("claim"),
        F.col("f.tier").alias("tier"), F.col("f.bp").alias("confidence_bp"), "f.pack",
    )


def first_in_turn(rows: DataFrame, packs: list[Pack]) -> DataFrame:
    """The fact ``f`` of each row that a mapping reads: one conditional of all mappings."""
    out: Column = F.lit(None).cast("struct<path:string,op:string,value:string,tier:int,bp:int,pack:string>")
    ordered = [(p, m) for p in packs for m in p.mappings]
    for p, m in reversed(ordered):
        own = F.col("vendor") == p.vendor
        if p.os is not None:
            own = own & (F.col("os").isNull() | (F.col("os") == p.os))
        hit, value = matched(m)
        fact = F.struct(F.lit(m.path).alias("path"), F.lit(_written(m)).alias("op"), value.alias("value"), F.lit(m.tier).alias("tier"), F.lit(round(m.confidence * 10000)).alias("bp"), F.lit(p.id).alias("pack"))
        out = F.when(own & hit & value.isNotNull(), fact).otherwise(out)
    return rows.withColumn("f", out).where("f is not null")


def _written(m: Mapping) -> str:
    return "append" if SCALARS.get(m.path) == "array" else "set"


_INDEX = "vendor string, key string, place int, pack_os string, match string, value_group int, within string, transform string, lookup map<string,string>, path string, op string, tier int, bp int, pack string"


def index(packs: list[Pack]) -> list[tuple]:
    """The mappings of packs as rows of ``_INDEX``, one per key that a line must have to match."""
    ordered = [(p, m) for p in packs for m in p.mappings]
    out = []
    for place, ((p, m), keys) in enumerate(zip(ordered, keys_of([m.match for _, m in ordered]), strict=True)):
        group, values = re.compile(m.match).groupindex.get("value"), {k.lower(): str(v) for k, v in m.values.items()}
        for key in sorted(keys):
            out.append((p.vendor, key, place, p.os, _java(m.match), group, m.within and _java(m.within), m.transform, values, m.path, _written(m), m.tier, round(m.confidence * 10000), p.id))
    return out


def first_by_index(rows: DataFrame, packs: list[Pack]) -> DataFrame:
    """device_id, file, line_no and the fact ``f`` of each line that a mapping reads, lines being known by these columns.

    A line meets only the mappings with which it shares a key (``anchors``); the first in the packs' order that
    matches and transforms counts.  The index is broadcast up to ``INDEX_BYTES``, and joined by its keys beyond."""
    made = index(packs)
    mappings = rows.sparkSession.createDataFrame(made, _INDEX)
    if sum(len(str(x)) for row in made for x in row) <= INDEX_BYTES:
        mappings = F.broadcast(mappings)
    kinds = {row[1][:1] for row in made}
    keyed = rows.select("device_id", "file", "line_no", "text", "context", "vendor", "os", F.explode(text_keys(F.col("text"), kinds)).alias("key"))
    met = keyed.join(mappings, ["vendor", "key"]).where(F.col("pack_os").isNull() | F.col("os").isNull() | (F.col("os") == F.col("pack_os")))
    inside = F.col("within").isNull() | F.coalesce(F.exists("context", lambda h: F.rlike(h, F.col("within"))), F.lit(False))
    raw = F.when(F.col("value_group").isNull(), "").otherwise(F.expr("regexp_extract(text, match, value_group)"))
    hits = met.where(F.rlike("text", F.col("match")) & inside).withColumn("value", transform_named(F.col("transform"), raw, F.col("lookup"))).where("value is not null")
    return hits.groupBy("device_id", "file", "line_no").agg(F.min_by(F.struct("path", "op", "value", "tier", "bp", "pack"), "place").alias("f"))


def structural(residue: DataFrame) -> DataFrame:
    """Claims of unread lines whose meaning is their place: blanks, comments, separators and closers."""
    text = F.col("text")
    hit = (text == "") | reduce(or_, (text.startswith(c) for c in COMMENTS)) | F.lower(text).isin(*CLOSERS)
    none = {"path": "string", "op": "string", "entity": "int", "value": "string", "secret": "string"}
    return residue.where(hit).select("device_id", "file", "line_no", F.lit(0).alias("sub"), *(F.lit(None).cast(t).alias(n) for n, t in none.items()), F.lit(True).alias("claim"), F.lit(1).alias("tier"), F.lit(10000).alias("confidence_bp"), F.lit(None).cast("string").alias("pack"))
