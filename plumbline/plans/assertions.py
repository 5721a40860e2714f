"""The assertion language, compiled to Catalyst expressions.

``compile_assertion`` turns a source text into a ``Compiled`` whose columns are evaluated by Spark: the
three-valued result (NULL is unknown) and the paths that were touched, missing and absent.  Types are
settled at compile time against the schema of the document, so a comparison that could never hold is
folded before any job runs, and a malformed text fails before any job is planned.

Grammar, loosest first: ``or``, ``and``, ``not``, one comparison (``== != < <= > >= in``), and
primaries: integers, quoted strings, true, false, null, lists (bare words inside are strings), paths,
parentheses and calls of defined, empty, count, all, any, subset.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class AssertionSyntaxError(ValueError):
    """The text isn't an assertion."""


_SCAN = re.compile(
    r"\s*(?:(?P<num>-?\d+(?:\.\d+)?)|(?P<str>\"[^\"]*\"|'[^']*')|(?P<op>[<>=!]=|[<>])|(?P<sign>[()\[\],])"
    r"|(?P<name>[A-Za-z_][\w.-]*(?:\[\d+\][\w.-]*)*))"
)
WORDS = {"and", "or", "not", "in", "true", "false", "null"}
ARITY = {"defined": 1, "empty": 1, "count": 1, "all": 2, "any": 2, "subset": 2}


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    parts: tuple[Node, ...] = ()


def tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = source.rstrip()
    while at < len(text):
        m = _SCAN.match(text, at)
        if not m:
            raise AssertionSyntaxError(f"unexpected character at {at} in {source!r}")
        kind, value = m.lastgroup or "", m.group(m.lastgroup or 0)
        out.append((value.lower(), value) if kind == "name" and value.lower() in WORDS else (kind, value))
        at = m.end()
    return out


class _Reader:
    """Precedence climbing over the token list."""

    LEVELS = ("or", "and")

    def __init__(self, source: str):
        self.source, self.left = source, tokens(source)[::-1]

    def next(self, *wanted: str) -> str | None:
        """Take the next token if its kind or text is wanted."""
        if self.left and (self.left[-1][0] in wanted or (self.left[-1][0] == "sign" and self.left[-1][1] in wanted)):
            return self.left.pop()[1]
        return None

    def need(self, sign: str) -> None:
        if self.next(sign) is None:
            raise AssertionSyntaxError(f"expected {sign!r} in {self.source!r}")

    def whole(self) -> Node:
        node = self.level(0)
        if self.left:
            raise AssertionSyntaxError(f"unexpected {self.left[-1][1]!r} in {self.source!r}")
        return node

    def level(self, k: int) -> Node:
        if k == len(self.LEVELS):
            return self.negated()
        node = self.level(k + 1)
        while self.next(self.LEVELS[k]):
            node = Node(self.LEVELS[k], None, (node, self.level(k + 1)))
        return node

    def negated(self) -> Node:
        if self.next("not"):
            return Node("not", None, (self.negated(),))
        left = self.primary()
        op = self.next("op", "in")
        return Node("compare", op.lower(), (left, self.primary())) if op else left

    def many(self, close: str, item: Callable[[], Node]) -> tuple[Node, ...]:
        if self.next(close):
            return ()
        out = [item()]
        while self.next(","):
            out.append(item())
        self.need(close)
        return tuple(out)

    def primary(self, in_list: bool = False) -> Node:
        if not self.left:
            raise AssertionSyntaxError(f"{self.source!r} ends too early")
        kind, text = self.left.pop()
        if kind == "num":
            if "." in text:
                raise AssertionSyntaxError(f"decimal literal {text}: only integers compare the same everywhere")
            return Node("literal", int(text))
        if kind == "str":
            return Node("literal", text[1:-1])
        if kind in ("true", "false", "null"):
            return Node("literal", {"true": True, "false": False, "null": None}[kind])
        if text == "(" and kind == "sign":
            node = self.level(0)
            self.need(")")
            return node
        if text == "[" and kind == "sign":
            return Node("list", None, self.many("]", lambda: self.primary(True)))
        if kind == "name":
            if self.next("("):
                if text not in ARITY:
                    raise AssertionSyntaxError(f"unknown function {text}()")
                args = self.many(")", lambda: self.level(0))
                if len(args) != ARITY[text]:
                    raise AssertionSyntaxError(f"{text}() takes {ARITY[text]} arguments")
                if text == "defined" and args[0].kind != "path":
                    raise AssertionSyntaxError("defined() takes a path")
                return Node("call", text, args)
            return Node("literal", text) if in_list else Node("path", text)
        raise AssertionSyntaxError(f"unexpected {text!r} in {self.source!r}")


def parse(source: str) -> Node:
    return _Reader(source).whole()


_NONE = "array<string>"


def _paths(*items: str) -> Column:
    return F.array(*(F.lit(i) for i in items)).cast(_NONE)


@dataclass
class Term:
    """A compiled node; ``type`` None is the null literal, NullType a value that is never known."""

    value: Column
    type: T.DataType | None
    touched: Column = field(default_factory=_paths)
    missing: Column = field(default_factory=_paths)
    absent: Column = field(default_factory=_paths)
    items: tuple | None = None

    def traced(self, *others: Term) -> dict[str, Column]:
        return {k: F.concat(getattr(self, k), *(getattr(o, k) for o in others)) for k in ("touched", "missing", "absent")}


@dataclass
class Compiled:
    value: Column
    touched: Column
    missing: Column
    absent: Column

    def verdict(self) -> Column:
        return F.when(self.value.isNull(), "unknown").when(self.value, "pass").otherwise("fail")


def _is(t: T.DataType | None, *kinds: type) -> bool:
    return isinstance(t, kinds)


_NUMBERS = (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.BooleanType)


def truth(term: Term) -> Column:
    t = term.type
    if t is None:
        return F.lit(False)
    if _is(t, T.BooleanType):
        return term.value
    if _is(t, *_NUMBERS, T.DoubleType, T.FloatType, T.DecimalType):
        return term.value != 0
    if _is(t, T.StringType):
        return term.value != ""
    if _is(t, T.ArrayType):
        return F.when(term.value.isNotNull(), F.size(term.value) > 0)
    if _is(t, T.NullType):
        return F.lit(None).cast("boolean")
    return F.when(term.value.isNotNull(), F.lit(True))


class Compiler:
    """Compiles against a document: a struct schema and a function from a root name to its column."""

    def __init__(self, schema: T.StructType, root: Callable[[str], Column] = F.col):
        self.schema, self.root = schema, root

    def compile(self, source: str | Node) -> Compiled:
        term = self.term(parse(source) if isinstance(source, str) else source, None)
        return Compiled(truth(term), *(F.array_distinct(c) for c in (term.touched, term.missing, term.absent)))

    def term(self, node: Node, element: tuple[Column, T.DataType] | None) -> Term:
        return getattr(self, f"_{node.kind}")(node, element)

    def _literal(self, node: Node, element) -> Term:
        v = node.value
        if v is None:
            return Term(F.lit(None), None, items=(None,))
        kind = T.BooleanType() if isinstance(v, bool) else T.LongType() if isinstance(v, int) else T.StringType()
        return Term(F.lit(v).cast(kind), kind, items=(v,))

    def _list(self, node: Node, element) -> Term:
        parts = [self.term(p, element) for p in node.parts]
        values = tuple(p.items[0] if p.items else None for p in parts)
        kinds = {type(v) for v in values if v is not None}
        if kinds <= {int, bool}:
            kind: T.DataType = T.LongType()
            columns = [p.value.cast("long") for p in parts]
        else:
            kind = T.StringType()
            columns = [p.value if isinstance(v, str) else F.lit(None).cast("string") for p, v in zip(parts, values, strict=True)]
        return Term(F.array(*columns).cast(T.ArrayType(kind)), T.ArrayType(kind), items=values)

    def _step(self, value: Column, kind: T.DataType, part: str) -> tuple[Column, T.DataType] | None:
        name, *indexes = re.split(r"\[(\d+)\]", part)
        if name:
            if not _is(kind, T.StructType) or name not in kind.names:
                return None
            value, kind = value.getField(name), kind[name].dataType
        for i in filter(None, indexes):
            if not _is(kind, T.ArrayType):
                return None
            value, kind = F.get(value, F.lit(int(i))), kind.elementType
        return value, kind

    def _path(self, node: Node, element) -> Term:
        path = str(node.value)
        first, *rest = path.split(".")
        name = first.split("[")[0]
        if element is not None and name not in self.schema.names:
            at: tuple[Column, T.DataType] | None = element
            for part in rest:
                at = self._step(*at, part) if at else None
            return Term(*at) if at else Term(F.lit(None), T.NullType(), missing=_paths(path))
        at = (self.root(name), self.schema[name].dataType) if name in self.schema.names else None
        if at and first != name:
            at = self._step(*at, first[len(name) :])
        for part in rest:
            at = self._step(*at, part) if at else None
        if at is None:
            return Term(F.lit(None), T.NullType(), missing=_paths(path))
        known = at[0].isNotNull()
        return Term(*at, touched=F.when(known, _paths(path)).otherwise(_paths()), missing=F.when(known, _paths()).otherwise(_paths(path)))

    def _not(self, node: Node, element) -> Term:
        x = self.term(node.parts[0], element)
        return Term(~truth(x), T.BooleanType(), **x.traced())

    def _both(self, node: Node, element, settles: bool) -> Term:
        a, b = (self.term(p, element) for p in node.parts)
        x, y = truth(a), truth(b)
        settled = x.eqNullSafe(F.lit(settles))  # what the other side read doesn't count then
        trace = {k: F.when(settled, getattr(a, k)).otherwise(F.concat(getattr(a, k), getattr(b, k))) for k in ("touched", "missing", "absent")}
        return Term((x | y) if settles else (x & y), T.BooleanType(), **trace)

    def _and(self, node: Node, element) -> Term:
        return self._both(node, element, False)

    def _or(self, node: Node, element) -> Term:
        return self._both(node, element, True)

    def _compare(self, node: Node, element) -> Term:
        a, b = (self.term(p, element) for p in node.parts)
        return Term(self._compared(str(node.value), a, b), T.BooleanType(), **a.traced(b))

    def _compared(self, op: str, a: Term, b: Term) -> Column:
        unknown = F.lit(None).cast("boolean")
        known = F.lit(True)
        for t in (a, b):
            if t.type is not None:
                if _is(t.type, T.NullType):
                    return unknown
                known = known & t.value.isNotNull()

        def fixed(v: bool) -> Column:
            return F.when(known, F.lit(v))

        if op == "in":
            if _is(b.type, T.ArrayType):
                left = a.value.cast("long") if _is(a.type, *_NUMBERS) else a.value
                inner = b.type.elementType
                if a.type is None:
                    return F.when(known, F.exists(b.value, lambda x: x.isNull())) if b.items is None or None in b.items else fixed(False)
                if (_is(a.type, *_NUMBERS) and _is(inner, *_NUMBERS)) or (_is(a.type, T.StringType) and _is(inner, T.StringType)):
                    right = b.value.cast("array<bigint>") if _is(inner, *_NUMBERS) else b.value
                    return F.when(known, F.coalesce(F.array_contains(right, left), F.lit(False)))
                return fixed(False)
            if _is(b.type, T.StringType):
                return F.contains(b.value, a.value) if _is(a.type, T.StringType) else unknown
            return fixed(False)
        if a.type is None or b.type is None:
            same = a.type is None and b.type is None
            return fixed(same) if op == "==" else fixed(not same) if op == "!=" else unknown
        if _is(a.type, *_NUMBERS) and _is(b.type, *_NUMBERS):
            x, y = a.value.cast("long"), b.value.cast("long")
        elif type(a.type) is type(b.type) or (_is(a.type, T.DoubleType, *_NUMBERS) and _is(b.type, T.DoubleType, *_NUMBERS)):
            x, y = a.value, b.value
        else:
            return fixed(op == "!=") if op in ("==", "!=") else unknown
        return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def _call(self, node: Node, element) -> Term:
        return getattr(self, f"_fn_{node.value}")(node, element)

    def _fn_defined(self, node: Node, element) -> Term:
        path = str(node.parts[0].value)
        x = self.term(node.parts[0], element)
        there = x.value.isNotNull()
        name = path.split(".")[0].split("[")[0]
        if element is None and name in self.schema.names:
            section = self.root(name).isNotNull()
            return Term(
                F.when(section, there),
                T.BooleanType(),
                touched=F.when(section, x.touched).otherwise(_paths()),
                missing=F.when(section, _paths()).otherwise(_paths(name)),
                absent=F.when(section & ~there, _paths(path)).otherwise(_paths()),
            )
        return Term(there, T.BooleanType(), touched=x.touched, absent=F.when(there, _paths()).otherwise(_paths(path)))

    def _sized(self, x: Term) -> Column | None:
        if _is(x.type, T.ArrayType, T.MapType):
            return F.when(x.value.isNotNull(), F.size(x.value))
        if _is(x.type, T.StringType):
            return F.length(x.value)
        if _is(x.type, T.StructType):
            return F.when(x.value.isNotNull(), F.lit(len(x.type.names)))
        return None

    def _fn_empty(self, node: Node, element) -> Term:
        x = self.term(node.parts[0], element)
        size = self._sized(x)
        value = F.lit(True) if x.type is None else F.when(x.value.isNotNull(), F.lit(False)) if size is None else size == 0
        return Term(value, T.BooleanType(), **x.traced())

    def _fn_count(self, node: Node, element) -> Term:
        x = self.term(node.parts[0], element)
        size = self._sized(x)
        return Term(F.lit(None).cast("long") if size is None else size.cast("long"), T.LongType(), **x.traced())

    def _quantified(self, node: Node, element, every: bool) -> Term:
        x = self.term(node.parts[0], element)
        if not _is(x.type, T.ArrayType):
            return Term(F.lit(None).cast("boolean"), T.BooleanType(), **x.traced())
        inner = x.type.elementType
        test = lambda e: truth(self.term(node.parts[1], (e, inner)))
        value = (F.forall if every else F.exists)(x.value, test)
        # what defined() looked for in vain in some element
        lost = F.array_distinct(F.flatten(F.transform(x.value, lambda e: self.term(node.parts[1], (e, inner)).absent)))
        absent = F.concat(x.absent, F.coalesce(lost, _paths()))
        return Term(value, T.BooleanType(), touched=x.touched, missing=x.missing, absent=absent)

    def _fn_all(self, node: Node, element) -> Term:
        return self._quantified(node, element, True)

    def _fn_any(self, node: Node, element) -> Term:
        return self._quantified(node, element, False)

    def _fn_subset(self, node: Node, element) -> Term:
        a, b = (self.term(p, element) for p in node.parts)
        if not (_is(a.type, T.ArrayType) and _is(b.type, T.ArrayType)) or _is(a.type.elementType, T.StructType, T.ArrayType):
            return Term(F.lit(None).cast("boolean"), T.BooleanType(), **a.traced(b))
        left, right = a.value, b.value
        if _is(a.type.elementType, *_NUMBERS) and _is(b.type.elementType, *_NUMBERS):
            left, right = left.cast("array<bigint>"), right.cast("array<bigint>")
        elif type(a.type.elementType) is not type(b.type.elementType):
            return Term(F.when(left.isNotNull() & right.isNotNull(), F.size(left) == 0), T.BooleanType(), **a.traced(b))
        return Term(F.when(left.isNotNull() & right.isNotNull(), F.size(F.array_except(left, right)) == 0), T.BooleanType(), **a.traced(b))


def compile_assertion(source: str, schema: T.StructType, root: Callable[[str], Column] = F.col) -> Compiled:
    return Compiler(schema, root).compile(source)
