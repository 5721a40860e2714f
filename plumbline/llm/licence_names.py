"""Licences by their full texts, their names and their SPDX tags; what ``licences`` adds to its notices.

A file's text is first freed of comment leaders, so that wrapped headers read as paragraphs.

* SPDX: the expression of the first ``SPDX-License-Identifier:`` line counts, whatever its ids are.
* Texts: the whole file and each paragraph (the lines up to an empty one) are compared with the full
  texts of ``licence_texts`` and with the grants of those that name no licence (MIT, ISC, BSD, ...), by
  TF-IDF cosine of at least ``LEAST_TEXT``; weights come from the templates, so a file's licence doesn't
  depend on the others.  A template has a key phrase, and only units that hold it are compared with it.
* Names: a grant ("distributed under the terms of the ...") followed by a licence's name, across lines.

Everything is DataFrame operations; the templates are the only broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written

LEAST_TEXT = 0.75
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GNU = " (?:as )?published by the free software foundation"

#: (licence, pattern of its name in words), the more special first.
NAMES = [
    ("Apache-2.0", r"apache(?: software)?(?: license| licence)? ?(?:version |v )?v?2(?: 0)?|asl 2 0|apache 2(?: 0)? licen[sc]e"),
    ("Apache-1.1", r"apache(?: software)? licen[sc]e (?:version |v )?v?1 1"),
    *(
        (f"{spdx}-{number}", rf"(?:gnu )?(?:{name})(?: licen[sc]e)?(?: {abbreviation})?(?:{_GNU})?(?: either)? ?(?:version |v)?{pattern}|(?:gnu )?{abbreviation} ?(?:version |v)?{pattern}")
        for spdx, name, abbreviation, numbers in (
            ("AGPL", "affero general public|general affero public", "agpl", ("3.0",)),
            ("LGPL", "lesser general public|library general public|library or lesser general public", "lgpl", ("2.0", "2.1", "3.0")),
            ("GPL", "general public", "gpl", ("1.0", "2.0", "3.0")),
            ("GFDL", "free documentation", "g?fdl", ("1.1", "1.2", "1.3")),
        )
        for number in numbers
        for pattern in (number.replace(".0", "(?: 0)?(?! [1-9]\\b)").replace(".", " "),)
    ),
    ("MPL-2.0", r"(?:mozilla public licen[sc]e|mpl) ?(?:version |v )?v?2(?: 0)?"),
    ("MPL-1.1", r"(?:mozilla public licen[sc]e|mpl) ?(?:version |v )?v?1 1"),
    ("EPL-2.0", r"(?:eclipse public licen[sc]e|epl) ?(?:version |v )?v?2(?: 0)?"),
    ("EPL-1.0", r"(?:eclipse public licen[sc]e|epl) ?(?:version |v )?v?1(?: 0)?"),
    ("BSD-2-Clause", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: style)?"),
    ("BSD-3-Clause", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: style)?"),
    ("MIT", r"mit(?: expat)? licen[sc]e|expat licen[sc]e|mit"),
    ("ISC", r"isc licen[sc]e|isc"),
    ("BSL-1.0", r"boost software licen[sc]e"),
    ("Zlib", r"zlib licen[sc]e"),
    ("CC0-1.0", r"cc0|creative commons zero"),
    ("Unlicense", r"unlicen[sc]e"),
]
_GRANT = (
    r"(?<!\bnot )\b(?:licen[sc]ed|released|distributed|redistributed?(?: it)?(?: and or modify it)?|published|provided|covered|governed|(?:made )?available|offered|subject)"
    r" (?:freely )?(?:under|by|to)(?: the terms(?: and conditions)? of)?(?: the| a| an| its)?(?: following)?(?: terms of the)?(?: open source)? (?:"
)
_CC = r"\b(?:cc|creative commons) ((?:(?:by|nc|sa|nd|attribution|non ?commercial|share ?alike|no ?deriv(?:s|atives|ative)(?: works)?) )+)(?:licen[sc]e )?(?:version |v)?([1-4]) ([05])\b"
_CC_PARTS = [("BY", "by|attribution"), ("NC", "nc|non ?commercial"), ("ND", r"nd|no ?deriv(?:s|atives|ative)(?: works)?"), ("SA", "sa|share ?alike")]
SPDX = r"(?i)spdx-licen[sc]e-identifier:[ \t]*((?:[()]*[a-z0-9][a-z0-9.+_-]*[()]*(?:[ \t]+(?:(?:and|or|with)[ \t]+)(?=[(a-z0-9]))?)+)"
#: Texts without any of these are not looked at: each key, name and tag holds one, or a short name after a grant.
SOME = ["licen", "permission", "redistribut", "unencumbered", "misrepresented", "commons", "artistic", "apache", "cc0", "gpl", "bsd", "fdl", "gnu", "general public"]
SHORT = r"cc[^a-z0-9]+(?:by|nc|sa|nd|attribution|non|share|no)|(?:under|by|to)[^a-z0-9]+(?:(?:the|terms|and|conditions|of|a|an|its|following|open|source)[^a-z0-9]+)*(?:mit|isc|asl|(?:mpl|epl)[v0-9]*)(?![a-z])"
_LEADER = r"(?mi)^[ \t]*(?:/\*+|\*+/|\*+|//+!?|#+!?|;+|--+|%+|<!--+|\.\.|dnl\b|rem\b|>)?[ \t]*|[ \t]*(?:\*+/|--+>)?[ \t\r]*$"

#: Key phrases of the texts, in words.
KEYS = {
    "0BSD": "permission to use copy modify",
    "Apache-2.0": "terms and conditions for use reproduction and distribution",
    "Artistic-1.0-Perl": "artistic license",
    "BSD-2-Clause": "redistribution and use in source and binary forms",
    "BSD-3-Clause": "redistribution and use in source and binary forms",
    "BSL-1.0": "any person or organization obtaining a copy",
    "CC0-1.0": "cc0 1 0 universal",
    "GFDL-1.2": "gnu free documentation license",
    "GFDL-1.3": "gnu free documentation license",
    "GPL-1.0": "gnu general public license",
    "GPL-2.0": "gnu general public license",
    "GPL-3.0": "gnu general public license",
    "ISC": "permission to use copy modify",
    "LGPL-2.0": "library general public license",
    "LGPL-2.1": "lesser general public license",
    "LGPL-3.0": "lesser general public license",
    "MIT": "any person obtaining a copy",
    "MPL-1.1": "mozilla public license",
    "MPL-2.0": "mozilla public license",
    "Unlicense": "free and unencumbered software",
    "Zlib": "must not be misrepresented",
}
#: Paragraphs that say a licence by themselves: licence, rank (a deciding clause outranks a grant), place, key.
PARAGRAPHS = [
    ("0BSD", 0, 0, "permission to use copy modify"),
    ("BSD-2-Clause", 0, 0, "redistribution and use in source and binary forms"),
    ("BSD-3-Clause", 1, 3, "endorse or promote products derived from this software"),
    ("BSL-1.0", 0, 1, "any person or organization obtaining a copy"),
    ("ISC", 0, 0, "permission to use copy modify"),
    ("MIT", 0, 0, "any person obtaining a copy"),
    ("Unlicense", 0, 0, "free and unencumbered software"),
    ("Zlib", 0, 1, "permission is granted to anyone to use this software"),
]


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))


def full_texts() -> dict[str, str]:
    return {p.name.removesuffix(".txt"): p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


def templates() -> list[tuple[str, int, str, str]]:
    """(licence, rank, key, text): whole texts rank 2, paragraphs as they say."""
    texts = full_texts()
    out = [(k, 2, KEYS[k], t) for k, t in texts.items()]
    return out + [(k, rank, key, texts[k].split("\n\n")[place]) for k, rank, place, key in PARAGRAPHS]


def normal(text: Column) -> Column:
    """Lower-case words with single spaces between, before and after."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " ")), F.lit(" "))


def plain(text: Column) -> Column:
    """The text without comment leaders and line ends' blanks."""
    return F.regexp_replace(text, _LEADER, "")


def _order() -> Column:
    return F.struct(-F.col("rank"), -F.col("cosine"), "licence")


def by_text(files: DataFrame) -> DataFrame:
    """path, rank, cosine, licence of each file's best full text or grant; ``files`` is (path, plain)."""
    found = templates()
    counts = [Counter(words_of(t)) for _, _, _, t in found]
    df = Counter(w for c in counts for w in c)
    other = math.log(len(found) + 1) + 1
    idf = {w: math.log((len(found) + 1) / (n + 1)) + 1 for w, n in df.items()}
    shares: dict[str, list] = {w: [] for w in idf}
    for t, c in enumerate(counts):
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        for w, n in c.items():
            shares[w].append((t, n * idf[w] * idf[w] / norm))
    table = files.sparkSession.createDataFrame([(w, idf[w], s) for w, s in sorted(shares.items())], "w string, idf double, shares array<struct<t: int, x: double>>")
    keys = sorted({key for _, _, key, _ in found})
    held = F.array_compact(F.array(*(F.when(F.contains("norm", F.lit(f" {k} ")), F.lit(i)) for i, k in enumerate(keys))))
    keyed = reduce(or_, (F.contains("norm", F.lit(f" {k} ")) for k in keys))
    units = files.where(keyed).select("path", F.explode(F.array_distinct(F.concat(F.array("plain"), F.split("plain", r"\n\s*\n")))).alias("unit"))
    units = units.select("path", normal(F.col("unit")).alias("norm")).withColumn("keys", held).where(F.size("keys") > 0)
    units = units.select("path", F.array_join("keys", ",").alias("keys"), F.sha1("norm").alias("u"), F.split(F.trim("norm"), " ").alias("ws")).dropDuplicates(["path", "u"])
    terms = units.select("path", "u", "keys", F.explode("ws").alias("w")).groupBy("path", "u", "keys", "w").agg(F.count("*").alias("tf"))
    terms = terms.join(F.broadcast(table), "w", "left")
    own = F.array(F.struct(F.lit(-1).alias("t"), F.pow(F.coalesce("idf", F.lit(other)) * F.col("tf"), F.lit(2.0)).alias("x")))
    parts = F.concat(own, F.transform(F.coalesce("shares", F.array().cast("array<struct<t: int, x: double>>")), lambda s: F.struct(s.t.alias("t"), (s.x * F.col("tf")).alias("x"))))
    sums = terms.select("path", "u", "keys", F.explode(parts).alias("p")).groupBy("path", "u", "keys", F.col("p.t").alias("t")).agg(F.sum("p.x").alias("x"))
    whole = sums.groupBy("path", "u", "keys").agg(F.max(F.when(F.col("t") < 0, F.sqrt("x"))).alias("norm"), F.collect_list(F.when(F.col("t") >= 0, F.struct("t", "x"))).alias("dots"))
    of = files.sparkSession.createDataFrame([(t, k, rank, str(keys.index(key))) for t, (k, rank, key, _) in enumerate(found)], "t int, licence string, rank int, key string")
    dots = whole.select("path", "keys", "norm", F.explode("dots").alias("d")).select("path", "keys", "norm", "d.*").join(F.broadcast(of), "t")
    scored = dots.where(F.array_contains(F.split("keys", ","), F.col("key"))).select("path", "rank", F.round(F.col("x") / F.col("norm"), 6).alias("cosine"), "licence")
    best = scored.where(F.col("cosine") >= LEAST_TEXT).groupBy("path").agg(F.min_by(F.struct("rank", "cosine", "licence"), _order()).alias("b"))
    return best.select("path", "b.*")


def by_name(files: DataFrame) -> DataFrame:
    """path, rank, cosine, licence of the SPDX tag (rank 3) and of the first name (rank -1), where there are any."""
    tag = F.regexp_extract("plain", SPDX, 1)
    tag = F.regexp_replace(F.trim(tag), r"\b(A?GPL|LGPL|GFDL)-([0-9.]+)(-only|-or-later|\+)", "$1-$2")
    tag = F.regexp_replace(F.regexp_replace(tag, "[ \t]+", " "), r"^\((.*)\)$", "$1")
    said = F.regexp_extract("norm", _GRANT + "|".join(p for _, p in NAMES) + r")(?= )", 0)
    named = F.coalesce(*(F.when(F.regexp_extract("said", f" ({p})$", 0) != "", F.lit(k)) for k, p in NAMES))
    cc = F.regexp_extract("norm", _CC, 1)
    parts = F.concat_ws("-", F.lit("CC"), *(F.when(cc.rlike(rf"\b(?:{p})\b"), F.lit(k)) for k, p in _CC_PARTS))
    commons = F.when(cc != "", F.concat(parts, F.lit("-"), F.regexp_extract("norm", _CC, 2), F.lit("."), F.regexp_extract("norm", _CC, 3)))
    rows = files.select("path", tag.alias("tag"), "norm").withColumn("said", said)
    rows = written(rows, "licence-words", "zstd")
    rows = rows.select("path", F.when(F.col("tag") != "", F.col("tag")).alias("tag"), F.coalesce(F.when(F.col("said") != "", named), commons).alias("name"))
    rows = rows.where("tag is not null or name is not null")
    return rows.select("path", F.when(F.col("tag").isNotNull(), 3).otherwise(-1).alias("rank"), F.lit(1.0).alias("cosine"), F.coalesce("tag", "name").alias("licence"))


def read(files: DataFrame) -> DataFrame:
    """path, rank, cosine, licence: the best of the three ways; ``files`` is (path, text)."""
    hint = lambda t: reduce(or_, (F.contains(t, F.lit(w)) for w in SOME)) | t.rlike(SHORT)
    some = files.where(F.exists(F.array(F.lower("text")), hint)).select("path", plain(F.col("text")).alias("plain"))
    some = written(some, "licence-plain", "zstd")
    some = written(some.withColumn("norm", normal(F.col("plain"))), "licence-norm", "zstd")
    found = by_text(some).unionByName(by_name(some))
    return found.groupBy("path").agg(F.min_by(F.struct("rank", "cosine", "licence"), _order()).alias("b")).select("path", "b.*")
