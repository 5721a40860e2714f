"""Licence scans: sparse TF-IDF cosine to notice templates, then inheritance along paths.

Units are the sentences of a file, and of a licence file (by its name) also the whole text.  The
document frequency of every template word is counted over all files; a word that is in no template
weighs as one that no file has.  A unit whose cosine with a template is at least ``LEAST`` takes the
template's licence.  Only units with an anchor word are scored, which loses none: the words of a
template that are no anchors hold less than ``LEAST`` squared of its length.  A file without a notice
of its own takes the licence of the licence files of its directory or of the nearest ancestor that has
one, by equi-joins on directory paths.

Full licence texts, grants across lines, names and SPDX tags come from ``licence_names``: what they say
replaces a notice of another licence with a smaller cosine (full texts and SPDX tags any), and stands
where no notice is.

Everything is DataFrame operations; what comes to the driver are the frequencies of template words.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written
from plumbline.llm.licence_names import read

LEAST = 0.5
#: Fixed notices; each stands for a licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NAMES = r"^(LICENSE|LICENCE|COPYING)"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+"), lambda w: w != "")


def _words(text: str) -> list[str]:
    return [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split() if w]


def frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """How many files there are, and how many have each template word."""
    known = F.array(*map(F.lit, vocabulary))
    found = files.select(F.explode(F.array_union(F.array(F.lit("")), F.array_intersect(words(F.coalesce("text", F.lit(""))), known))).alias("w"))
    counts = {r.w: r.n for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return counts.pop("", 0), counts


def _weights(n: int, df: dict[str, int]) -> tuple[dict[str, float], float]:
    """The weight of each template word, and of any other word."""
    vocabulary = {w for t in TEMPLATES.values() for w in _words(t)}
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in sorted(vocabulary)}, math.log(n + 1) + 1


def _anchors(idf: dict[str, float]) -> list[str]:
    out: set[str] = set()
    for text in TEMPLATES.values():
        parts = sorted(((c * idf[w]) ** 2, w) for w, c in Counter(_words(text)).items())
        total, held = sum(p for p, _ in parts), 0.0
        for p, w in parts:  # the lightest words stay out while they can't reach the limit alone
            held += p
            if held >= LEAST**2 * total * (1 - 1e-9):
                out.add(w)
    return sorted(out)


def scan(files: DataFrame) -> DataFrame:
    """path, licence, how (notice, licence file, inherited or none), cosine, origin for each distinct
    path of ``files`` (path, text).

    ``origin`` is the path of the file whose notice counts.  Ties go to the larger cosine, rounded to
    six places, then to the first licence by name, and among licence files to the first path.  Several
    texts of one path count as one file's.  Null texts have no notice; rows without a path are left out.
    """
    spark = files.sparkSession
    base = files.where("path is not null").select("path", F.col("text").cast("string").alias("text"))
    vocabulary = sorted({w for t in TEMPLATES.values() for w in _words(t)})
    n, df = frequencies(base, vocabulary)
    idf, other = _weights(n, df)
    rows = []
    for name, text in TEMPLATES.items():
        tf = Counter(_words(text))
        norm = math.sqrt(sum((c * idf[w]) ** 2 for w, c in tf.items()))
        rows += [(w, name, c * idf[w] / norm) for w, c in tf.items()]
    templates = spark.createDataFrame(rows, "w string, licence string, share double")
    anchors = _anchors(idf)
    anchor = F.array(*map(F.lit, anchors))
    has_anchor = F.translate("text", UPPER, LOWER).rlike("(^|[^a-z0-9])(" + "|".join(anchors) + ")([^a-z0-9]|$)")
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    is_licence = F.translate(name, LOWER, UPPER).rlike(NAMES)

    sentences = F.split(F.regexp_replace("text", r"([.!?])[ \t]+", "$1\n"), "\n")
    units = F.when(is_licence, F.concat(F.array(F.col("text")), sentences)).otherwise(sentences)
    some = base.where(has_anchor).select("path", F.explode(units).alias("unit"))
    some = some.select("path", words(F.col("unit")).alias("ws")).where(F.arrays_overlap("ws", anchor))
    # equal units of a path are scored once
    some = some.select("path", F.array_sort("ws").alias("ws")).distinct().withColumn("u", F.sha1(F.array_join("ws", " ")))
    terms = some.select("path", "u", F.explode("ws").alias("w")).groupBy("path", "u", "w").agg(F.count("*").alias("tf"))
    weight = F.create_map(*[x for w, v in idf.items() for x in (F.lit(w), F.lit(v))])
    terms = terms.withColumn("v", F.col("tf") * F.coalesce(F.try_element_at(weight, F.col("w")), F.lit(other)))
    shares = templates.groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("licence", "share"))).alias("shares"))
    known = {r.w: r.shares for r in shares.collect()}
    share_of = lambda licence: F.create_map(*[x for w, m in sorted(known.items()) if licence in m for x in (F.lit(w), F.lit(m[licence]))])
    sums = terms.groupBy("path", "u").agg(
        F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"),
        *(F.sum(F.col("v") * F.coalesce(F.try_element_at(share_of(k), F.col("w")), F.lit(0.0))).alias(f"d{i}") for i, k in enumerate(TEMPLATES)),
    )
    best = F.array(*(F.struct(F.round(F.col(f"d{i}") / F.col("norm"), 6).alias("cosine"), F.lit(-i).alias("order"), F.lit(k).alias("licence")) for i, k in enumerate(TEMPLATES)))
    scored = sums.select("path", F.array_max(best).alias("b")).where(F.col("b.cosine") >= LEAST)
    own = scored.groupBy("path").agg(F.max("b").alias("b")).select("path", "b.cosine", "b.order", "b.licence")
    more = read(base).select("path", F.struct("cosine", F.lit(-len(TEMPLATES)).alias("order"), "licence", "rank").alias("more"))
    differs = F.col("licence").isNull() | (F.col("licence") != F.col("more.licence")) & ((F.col("cosine") < F.col("more.cosine")) | (F.col("more.rank") >= 2))
    chosen = lambda c: F.when(F.col("more").isNotNull() & differs, F.col(f"more.{c}")).otherwise(F.col(c)).alias(c)
    own = written(own.hint("merge").join(more, "path", "full").select("path", chosen("cosine"), chosen("order"), chosen("licence")), "notices")

    # the licence of each directory that has licence files
    held = own.where(is_licence).select(folder.alias("dir"), F.struct(F.col("cosine"), F.col("order"), F.lit(0)).alias("rank"), "path", "licence", "cosine")
    first = held.groupBy("dir").agg(F.min(F.struct(-F.col("cosine"), -F.col("rank.order"), F.col("path"), F.col("licence"))).alias("m"))
    holders = written(first.select("dir", F.col("m.path").alias("origin"), F.col("m.licence").alias("dir_licence"), (-F.col("m.col1")).alias("dir_cosine")), "directories")
    paths = written(base.select("path", folder.alias("dir")).distinct(), "paths")
    dirs = paths.select("dir").distinct()
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))
    above = dirs.select("dir", F.explode(F.array_distinct(up)).alias("a")).select("dir", F.col("a.depth").alias("depth"), F.col("a.above").alias("above"))
    near = above.join(holders.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by(F.struct("origin", "dir_licence", "dir_cosine"), "depth").alias("i"))
    near = written(near.select("dir", "i.*"), "inherited")

    joined = paths.join(own.hint("merge"), "path", "left").join(near.hint("merge"), "dir", "left")
    mine = F.col("licence").isNotNull()
    return joined.select(
        "path",
        F.coalesce("licence", "dir_licence").alias("licence"),
        F.when(mine & is_licence, "licence file").when(mine, "notice").when(F.col("origin").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.coalesce("cosine", "dir_cosine").alias("cosine"),
        F.when(mine, F.col("path")).otherwise(F.col("origin")).alias("origin"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """path, text: documents as files of a tree.  Texts of at most 400 characters are the licence files
    of their source and language; the others lie below, a hundred ids to a folder."""
    source, lang = F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-"))
    short = F.coalesce(F.length("text"), F.lit(0)) <= 400
    folder = F.floor(F.col("doc_id") / 100).cast("string")
    path = F.when(short, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select(F.concat(source, F.lit("/"), lang, F.lit("/"), path).alias("path"), "text")


def _oracle() -> str:
    values = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(TEMPLATES.items()))
    tokens = "regexp_extract_all(translate({}, '" + UPPER + "', '" + LOWER + "'), '[a-z0-9]+')"
    return f"""
WITH templates(i, licence, notice) AS (VALUES {values}),
template_words AS (SELECT i, licence, w, count(*) AS tf FROM (SELECT i, licence, unnest({tokens.format('notice')}) AS w FROM templates) GROUP BY ALL),
files AS (
  SELECT DISTINCT coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' ||
         CASE WHEN coalesce(length(text), 0) <= 400 THEN 'LICENSE-' || CAST(doc_id AS VARCHAR)
              ELSE CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || '.txt' END AS path,
         coalesce(text, '') AS text
  FROM documents WHERE doc_id IS NOT NULL
),
total AS (SELECT count(*) AS n FROM documents WHERE doc_id IS NOT NULL),
df AS (
  SELECT w, count(*) AS df FROM (SELECT list_distinct({tokens.format("coalesce(text, '')")}) AS ws FROM documents WHERE doc_id IS NOT NULL), UNNEST(ws) AS u(w)
  WHERE w IN (SELECT w FROM template_words) GROUP BY w
),
idf AS (SELECT DISTINCT t.w, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM template_words t CROSS JOIN total LEFT JOIN df USING (w)),
shares AS (
  SELECT i, licence, w, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY i)) AS share FROM template_words JOIN idf USING (w)
),
units AS (
  SELECT DISTINCT path, unit FROM (
    SELECT path, unnest(string_split(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))) AS unit FROM files
    UNION ALL SELECT path, text FROM files WHERE path LIKE '%/LICENSE-%'
  )
),
terms AS (SELECT path, unit, w, count(*) AS tf FROM (SELECT path, unit, unnest({tokens.format('unit')}) AS w FROM units) GROUP BY ALL),
weighed AS (SELECT path, unit, w, tf * coalesce(idf, (SELECT ln(n + 1) + 1 FROM total)) AS v FROM terms LEFT JOIN idf USING (w)),
norms AS (SELECT path, unit, sqrt(sum(v * v)) AS norm FROM weighed GROUP BY ALL),
cosines AS (
  SELECT path, unit, i, licence, round(sum(v * share) / any_value(norm), 6) AS cosine
  FROM weighed JOIN shares USING (w) JOIN norms USING (path, unit) GROUP BY path, unit, i, licence
),
own AS (
  SELECT path, licence, cosine, i FROM cosines WHERE cosine >= {LEAST}
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, i) = 1
),
placed AS (SELECT DISTINCT path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files),
holders AS (
  SELECT dir, path AS origin, licence, cosine FROM own JOIN placed USING (path) WHERE path LIKE '%/LICENSE-%'
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, i, path) = 1
),
near AS (
  SELECT path, h.origin, h.licence, h.cosine FROM placed p JOIN holders h ON p.dir = h.dir OR starts_with(p.dir, h.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(h.dir) DESC) = 1
)
SELECT p.path, coalesce(o.licence, n.licence) AS licence,
       CASE WHEN o.licence IS NOT NULL AND p.path LIKE '%/LICENSE-%' THEN 'licence file' WHEN o.licence IS NOT NULL THEN 'notice'
            WHEN n.origin IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       coalesce(o.cosine, n.cosine) AS cosine,
       CASE WHEN o.licence IS NOT NULL THEN p.path ELSE n.origin END AS origin
FROM placed p LEFT JOIN own o USING (path) LEFT JOIN near n USING (path)
"""


ORACLE = _oracle()
