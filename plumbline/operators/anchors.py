"""Which patterns a text can match at all: an inverted index from what a pattern requires.

Every match of a pattern holds certain literal text.  From it come a pattern's keys: whole words (``w:``), where
both their ends are fixed by the pattern, or else three letters in a row (``t:``).  A text meets only the patterns
with which it shares a key; patterns that require nothing have the key ``""``, which every text has.  Keys are in
lower case (A-Z only), so that they hold whether or not a pattern minds the case.  The index leaves out no match;
the pattern itself still decides.
"""

from __future__ import annotations

import re
from collections import Counter
from re import _constants as op
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[a-z0-9]+"
#: What may stand between literals: an end of words, such an end or nothing, anything at all.
END, PERHAPS, ANY = "end", "perhaps", "any"

_LETTERS = {ord(c) for c in UPPER + LOWER + "0123456789"}
_INLINE = (op.SUBPATTERN, op.ATOMIC_GROUP)
_REPEATS = (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT)


def _never_a_letter(kind: object, value: object) -> bool:
    """Whether a node matches one character that is neither a letter nor a digit of ASCII."""
    if kind is op.LITERAL:
        return value not in _LETTERS
    if kind is op.CATEGORY:
        return value in (op.CATEGORY_SPACE, op.CATEGORY_NOT_WORD)
    if kind is op.RANGE:
        return not any(value[0] <= c <= value[1] for c in _LETTERS)
    return kind is op.IN and all(_never_a_letter(k, v) for k, v in value)


def _symbols(tree: object) -> list:
    """A parsed pattern as literals (one character each), gaps, and lists of alternatives."""
    out: list = []
    for kind, value in tree:
        if kind is op.LITERAL:
            out.append(chr(value))
        elif kind is op.AT:
            out.append(ANY if value is op.AT_NON_BOUNDARY else END)
        elif kind in _INLINE:
            out += _symbols(value[-1] if kind is op.SUBPATTERN else value)
        elif kind in _REPEATS and len(value[2]) == 1 and _never_a_letter(*value[2][0]):
            out.append(END if value[0] else PERHAPS)
        elif kind in _REPEATS and value[0]:
            out += [ANY, *_symbols(value[2]), ANY]
        elif kind is op.BRANCH:
            out.append([_symbols(t) for t in value[1]])
        else:
            out.append(END if _never_a_letter(kind, value) else ANY)
    return out


def _ends_words(symbols: list, at: int, step: int) -> bool:
    """Whether the literal next to place ``at`` can't go on in the direction ``step``."""
    while 0 <= at < len(symbols) and symbols[at] == PERHAPS:
        at += step
    if not 0 <= at < len(symbols):
        return False
    s = symbols[at]
    return s == END or (isinstance(s, str) and len(s) == 1 and ord(s) not in _LETTERS)


def _literal(s: object) -> bool:
    return isinstance(s, str) and len(s) == 1 and s.isascii()


def _required(symbols: list) -> list[frozenset[str]]:
    """Sets of keys, of each of which every match has at least one."""
    found: list[frozenset[str]] = []
    k = 0
    while k < len(symbols):
        s = symbols[k]
        if isinstance(s, list):
            before, after = [END] * _ends_words(symbols, k - 1, -1), [END] * _ends_words(symbols, k + 1, 1)
            each = [min(_required(before + t + after), key=_plain_order, default=None) for t in s]
            if None not in each:
                found.append(frozenset().union(*each))
            k += 1
            continue
        if not _literal(s):
            k += 1
            continue
        e = k
        while e < len(symbols) and _literal(symbols[e]):
            e += 1
        run = "".join(symbols[k:e]).translate(str.maketrans(UPPER, LOWER))
        for m in re.finditer(WORD, run):
            left = m.start() > 0 or _ends_words(symbols, k - 1, -1)
            right = m.end() < len(run) or _ends_words(symbols, e, 1)
            if left and right:
                found.append(frozenset({"w:" + m[0]}))
        found += [frozenset({"t:" + run[i : i + 3]}) for i in range(len(run) - 2)]
        k = e
    return found


def _plain_order(keys: frozenset[str]) -> tuple:
    """Few keys before many, words before letters, long before short, then by text."""
    return len(keys), any(k.startswith("t:") for k in keys), -min(map(len, keys)), sorted(keys)


def required(pattern: str) -> list[frozenset[str]]:
    """Sets of keys of a pattern (see ``_required``); none where the pattern's meaning isn't surely the same in both
    dialects: classes within classes, flags for other alphabets, spaces that don't count, and quoted stretches."""
    if re.search(r"\[[^\]]*\[|&&|\(\?[a-z]*[ux]|\\[QEGRXhHvVpPkN]", pattern):
        return []
    return _required(_symbols(_parser.parse(pattern)))


def keys_of(patterns: list[str]) -> list[frozenset[str]]:
    """The keys under which each pattern is kept: of its required sets the one that the fewest patterns share."""
    sets = [required(p) for p in patterns]
    shared = Counter(k for s in sets for k in frozenset().union(*s))
    best = lambda keys: (sum(shared[k] for k in keys), _plain_order(keys))
    return [min(s, key=best, default=frozenset({""})) for s in sets]


def text_keys(text: Column, kinds: set[str]) -> Column:
    """The distinct keys of a text, of the kinds (first letters of keys) that are in an index."""
    low = F.translate(text, UPPER, LOWER)
    parts = [F.array(F.lit(""))] if "" in kinds else []
    if "w" in kinds:
        parts.append(F.transform(F.regexp_extract_all(low, F.lit(f"({WORD})")), lambda w: F.concat(F.lit("w:"), w)))
    if "t" in kinds:
        places = F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1)))
        parts.append(F.transform(places, lambda k: F.concat(F.lit("t:"), F.substring(low, k, F.lit(3)))))
    return F.array_distinct(F.concat(*parts))
