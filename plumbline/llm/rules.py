"""Quality rules: decision lists learned from labelled statistics.

Sequential covering: a rule is a conjunction of thresholds, grown literal by literal on two thirds of
the rows by information gain, then pruned on the last third; the rows that it covers are taken out
and the next one is grown.  A list is an ordered Spark conditional expression, so applying it is a
scan that code generation covers; only the statistics need Python.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import free_name, over_text, own_columns
from plumbline.llm.labelled import labelled_sample
from plumbline.llm.textvec import KEEP, Words, _lut, doc_chunks, mix, windows

#: Labelled rows of each class that the list is learned from.
MOST = 6000
RULES, LITERALS = 12, 4
#: A rule must reject this share of low-quality rows among those it covers, on either part.
PRECISION = 0.97

SYMBOLS = _lut(b"#*$%&|<>")
_NEWLINE = _lut(b"\n")
_UPPER = _lut(range(0x41, 0x5B))
_DIGIT = _lut(range(0x30, 0x3A))
_MARK = _lut(b"!")
_START = np.array([(b & 0xC0) != 0x80 for b in range(256)])

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_echoes"]
STATS = T.StructType([T.StructField(c, T.LongType(), False) for c in COUNTS])


def counts_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of each text of a chunk, in the order of ``COUNTS``."""
    n = len(offsets) - 1
    words = Words(data, offsets, KEEP)
    hashes, first = words.hashes(), words.first

    def per_doc(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    # words covered by five-word windows that occur again
    found, begin = windows(hashes, first, 5, 3)
    held = np.diff(begin)
    doc = np.repeat(np.arange(n), held)
    place = np.arange(len(found)) - begin[doc] + first[doc]
    key = mix(found + mix(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, dtype=bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    again = order[same[1:] | same[:-1]]
    edge = np.zeros(len(hashes) + 6, dtype=np.int64)
    np.add.at(edge, place[again], 1)
    np.add.at(edge, place[again] + 5, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[: len(hashes)] > 0)])
    repeats = covered[first[1:]] - covered[first[:-1]]

    # lines with a word, and those equal to an earlier one
    lines = Words(data, offsets, KEEP, _NEWLINE)
    solid = np.concatenate([[0], np.cumsum(words.solid)])
    wordy = solid[lines.ends] > solid[lines.starts]
    line_doc = lines.docs()[wordy]
    line_key = mix(lines.hashes()[wordy] + mix(line_doc.astype(np.uint64)))
    n_lines = np.bincount(line_doc, minlength=n)
    _, one = np.unique(line_key, return_index=True)
    dup = n_lines - np.bincount(line_doc[one], minlength=n)

    echo = np.zeros(len(hashes), dtype=bool)
    echo[1:] = hashes[1:] == hashes[:-1]
    echo[first[:-1][first[:-1] < len(hashes)]] = False
    echoes = np.concatenate([[0], np.cumsum(echo)])
    return np.stack(
        [
            words.counts,
            per_doc(words.solid & _START[data]),
            per_doc(SYMBOLS[data]),
            dup,
            repeats,
            n_lines,
            per_doc(_UPPER[data]),
            per_doc(_DIGIT[data]),
            per_doc(_MARK[data]),
            echoes[first[1:]] - echoes[first[:-1]],
        ],
        axis=1,
    ).astype(np.int64)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns but the last, which holds the text bytes, and then the statistics."""
    for batch in batches:
        for i, j, data, offsets in doc_chunks(batch.column(batch.num_columns - 1)):
            table = counts_of(data, offsets)
            stats = pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(len(COUNTS))], names=COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in range(batch.num_columns - 1)] + [stats], [*batch.schema.names[:-1], "stats"])


def with_stats(docs: DataFrame, name: str = "__stats") -> DataFrame:
    """``docs`` with a struct column of that name; null texts have no words."""
    return over_text(docs, _stats, [T.StructField(name, STATS, False)])


def features(stats: str = "__stats") -> dict[str, Column]:
    """What the literals compare: counts and shares, never null."""
    c = {k: F.col(f"{stats}.{k}").cast("double") for k in COUNTS}
    words, chars = F.greatest(c["n_words"], F.lit(1.0)), F.greatest(c["word_chars"], F.lit(1.0))
    return {
        "n_words": c["n_words"],
        "word_length": c["word_chars"] / words,
        "symbol_share": c["n_symbols"] / chars,
        "upper_share": c["n_upper"] / chars,
        "digit_share": c["n_digits"] / chars,
        "mark_share": c["n_marks"] / chars,
        "echo_share": c["n_echoes"] / words,
        "repeat_share": c["n_repeat_words"] / words,
        "dup_line_share": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1.0)),
    }


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    value: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] >= self.value if self.above else of[self.feature] < self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.value:.6g}"


Rule = tuple[Literal, ...]


def _covers(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    hit = np.ones(len(next(iter(table.values()))), dtype=bool)
    for x in rule:
        hit &= (table[x.feature] >= x.value) if x.above else (table[x.feature] < x.value)
    return hit


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    rule: list[Literal] = []
    hit = rows.copy()
    while len(rule) < LITERALS:
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if not p or not n:
            break
        base, best = math.log2(p / (p + n)), (1e-9, None)
        for name, values in table.items():
            own = values[hit]
            cuts = np.unique(np.quantile(own, np.linspace(0, 1, 65)[1:-1]))
            side = np.searchsorted(cuts, own, side="right")  # value >= cut k for k < side
            up_p = np.bincount(side[bad[hit]], minlength=len(cuts) + 1)[::-1].cumsum()[::-1][1:]
            up_n = np.bincount(side[~bad[hit]], minlength=len(cuts) + 1)[::-1].cumsum()[::-1][1:]
            for above, q, m in ((True, up_p, up_n), (False, p - up_p, n - up_n)):
                gain = np.where(q > 0, q * (np.log2(np.maximum(q, 1e-9) / np.maximum(q + m, 1e-9)) - base), -1.0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), Literal(name, above, float(cuts[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        hit &= _covers((best[1],), table)
    return tuple(rule)


def _prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray, left: np.ndarray) -> Rule:
    """The shortest beginning that is no worse on ``rows`` and covers no more good ones of ``left``,
    or as few as one in a hundred."""

    def worth(r: Rule) -> float:
        hit = _covers(r, table) & rows
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    def good(r: Rule) -> int:
        hit = _covers(r, table) & left
        return 0 if (hit & ~bad).sum() <= 0.01 * hit.sum() else int((hit & ~bad).sum())

    best, value, most = rule, worth(rule), good(rule)
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= value and good(rule[:k]) <= most:
            best, value = rule[:k], worth(rule[:k])
    return best


def learn(table: dict[str, np.ndarray], bad: np.ndarray, seed: int = 1) -> list[Rule]:
    """Rules, in order, each of which rejects what it covers."""
    n = len(bad)
    rules: list[Rule] = []
    if not n:
        return rules
    part = np.random.default_rng(seed).permutation(n) % 3
    left = np.ones(n, dtype=bool)
    while len(rules) < RULES and (left & bad).any():
        rule = _grow(table, bad, left & (part > 0))
        if not rule:
            break
        rule = _prune(rule, table, bad, left & (part == 0), left)
        hit = _covers(rule, table) & left
        good = [(hit & rows & bad).sum() / max(1, (hit & rows).sum()) for rows in (part > 0, part == 0)]
        if (hit & bad).sum() < 3 or min(good[0], good[1] if (hit & (part == 0)).any() else 1.0) < PRECISION:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def expression(rules: list[Rule], of: dict[str, Column]) -> Column:
    """The list as an ordered conditional: false where a rule rejects, else true."""
    out = None
    for rule in rules:
        test = rule[0].column(of)
        for x in rule[1:]:
            test = test & x.column(of)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed(stats: str = "__stats") -> Column:
    n, r = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < 10) | (100 * r > 20 * n)


def learn_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST) -> list[Rule]:
    """Rules that tell rows with ``label`` 0 from the others, from a bounded sample."""
    sample = with_stats(labelled_sample(docs, labels, label, most))
    of = features()
    rows = sample.select(*(v.alias(k) for k, v in of.items()), "label", "__id", F.xxhash64("text").alias("__key")).toArrow()
    order = np.lexsort((rows.column("__key").to_numpy(), rows.column("__id").to_numpy()))
    table = {k: rows.column(k).to_numpy()[order] for k in of}
    return learn(table, rows.column("label").to_numpy()[order] == 0)


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the statistics, base_failed and kept for each row of ``docs`` (doc_id, text).

    A null or empty text has no words and fails the base.  Repeated rows are judged each; other columns
    are ignored.  Without labels the list is empty and rejects nothing beyond the base.
    """
    rows = with_stats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.select("doc_id", *(F.col(f"__stats.{c}") for c in COUNTS[:5]), base_failed().alias("base_failed"), (~base_failed() & expression(rules, features())).alias("kept"))


def kept_rows(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that base and list keep, with all their columns."""
    name = free_name(docs, "stats")
    return with_stats(docs, name).where(~base_failed(name) & expression(rules, features(name))).select(*own_columns(docs))
