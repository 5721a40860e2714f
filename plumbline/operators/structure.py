"""Block structure of files in any grammar and of any depth: kinds, depths and the headers above each line.

Which blocks are open is the state of a stack, so a file's lines pass through one as a sorted stream: Spark
deals the files out and sorts them, and a task holds the open headers of one file, never the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

# Lines that close a block, what comments begin with, and where the path of a flat line ends.
CLOSERS = ["}", "};", "end", "exit", "quit", "return", "next", "exit-address-family", "!"]
COMMENTS = ("!", "#", "//", "/*", "*", ";")
FLAT_PATH = re.compile(r"^(/[\w/-]+(?:\s+[\w-]+)*?)\s+(?:set|add|remove|print|enable|disable)\b")
SET_PATH = re.compile(r"^(?:set|delete|deactivate)\s+\S+")
#: The line that separates sections, by grammar.
SEPARATORS = {"marker": "#", "indent": "!"}

BLANK, SEPARATOR, COMMENT, OPEN, CLOSE, STATEMENT = "blank", "separator", "comment", "block_open", "block_close", "statement"


def header(text: str) -> str:
    return text.rstrip("{ ").rstrip(";").strip()


class Stack:
    """The open blocks of one file."""

    def __init__(self, grammar: str):
        self.grammar = grammar
        self.held: list[tuple[int, str]] = []  # indent (0 in braces) and header

    def names(self) -> list[str]:
        return [h for _, h in self.held]

    def _shut(self, indent: int) -> None:
        while self.held and self.held[-1][0] >= indent:
            self.held.pop()

    def place(self, text: str, indent: int) -> tuple[str, int, list[str]]:
        """Kind, depth and context of the next line."""
        braces = self.grammar == "brace"
        if self.grammar in ("xml", "json"):
            return STATEMENT, 0, []
        if not text:
            return BLANK, len(self.held) if braces else 0, []
        if text == SEPARATORS.get(self.grammar):
            self.held.clear()
            return SEPARATOR, 0, []
        if text.startswith(COMMENTS):
            return COMMENT, len(self.held) if braces else 0, []
        if self.grammar == "flat":
            found = FLAT_PATH.match(text)
            return STATEMENT, 0, [found[1]] if found else [" ".join(text.split()[:3])] if SET_PATH.match(text) else []
        if braces:
            if text in ("}", "};"):
                del self.held[-1:]
                return CLOSE, len(self.held), []
            above = self.names()
            if text.endswith("{"):
                self.held.append((0, header(text)))
                return OPEN, len(above), above
            return STATEMENT, len(above), above
        closing = text.lower() in CLOSERS and bool(self.held)
        self._shut(indent)
        above = self.names()
        if closing:
            return CLOSE, len(above), []
        self.held.append((indent, header(text)))
        return STATEMENT, len(above), above


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack, file, text_above = Stack("unknown"), None, ""
    held: pa.RecordBatch | None = None  # the last row, whose kind the next one may change
    held_row: list = []

    def made(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        kinds, depths, contexts = (list(x) for x in zip(*rows, strict=True))
        arrays = [*batch.columns[:-1], pa.array(kinds), pa.array(depths, pa.int32()), pa.array(contexts, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "kind", "depth", "context"])

    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        read = [batch.column(names.index(c)).to_pylist() for c in ("device_id", "file", "text", "indent", "grammar")]
        rows: list[list] = []
        above = held_row
        for device, name, text, indent, grammar in zip(*read, strict=True):
            text = text or ""
            fresh = (device, name) != file
            if fresh:
                stack, file = Stack(grammar or "unknown"), (device, name)
            row = list(stack.place(text, indent or 0))
            if above and not fresh and grammar in SEPARATORS and above[0] == STATEMENT and row[2][-1:] == [header(text_above)]:
                above[0] = OPEN
            rows.append(row)
            above, text_above = row, text
        if held is not None:
            yield made(held, [held_row])
        if len(rows) > 1:
            yield made(batch.slice(0, batch.num_rows - 1), rows[:-1])
        held, held_row = batch.slice(batch.num_rows - 1), rows[-1]
    if held is not None:
        yield made(held, [held_row])


def grammar(lines: DataFrame) -> DataFrame:
    """device_id, file, grammar, score, confidence: which block grammar explains a file best.

    A file that begins with a bracket is JSON if its whole text parses; only such files are put together.
    """
    s = F.col("text")
    content = lines.where(s != "")
    c = lambda x: F.count_if(x).cast("double")
    a = content.groupBy("device_id", "file").agg(
        F.count("*").alias("n"), c(s.endswith("{")).alias("opens"), c(s.isin("}", "};")).alias("closes"), c(s.endswith(";")).alias("semis"),
        c(s.startswith("/") & ~s.rlike(r"^(//|/\*)")).alias("slash"), c(s.rlike(r"^(set|delete|deactivate)\s+\S+")).alias("sets"), c(s == "#").alias("hashes"), c(s == "!").alias("bangs"),
        c(F.col("raw").rlike(r"^[ \t]")).alias("indented"), F.min_by("text", "line_no").alias("head"), F.max(F.contains("raw", F.lit("</"))).alias("tags"),
    )
    maybe = a.where(F.col("head").rlike(r"^[{\[]")).select("device_id", "file")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]), "\n")
    parsed = lines.join(maybe, ["device_id", "file"], "left_semi").groupBy("device_id", "file").agg(F.try_parse_json(whole).isNotNull().alias("json"))
    a = a.join(parsed, ["device_id", "file"], "left")
    v = F.col
    scores = F.array(
        F.struct(F.when((v("opens") > 0) & (v("closes") > 0), (F.least("opens", "closes") * 2 + v("semis")) / v("n")).otherwise(0.0).alias("s"), F.lit(0).alias("o"), F.lit("brace").alias("g")),
        F.struct((F.greatest("slash", "sets") / v("n")).alias("s"), F.lit(-1).alias("o"), F.lit("flat").alias("g")),
        F.struct(F.when(v("hashes") >= 2, (v("hashes") * 3 + v("indented")) / v("n")).otherwise(0.0).alias("s"), F.lit(-2).alias("o"), F.lit("marker").alias("g")),
        F.struct(((v("indented") + v("bangs") * 2) / v("n")).alias("s"), F.lit(-3).alias("o"), F.lit("indent").alias("g")),
    )
    a = a.withColumn("r", F.reverse(F.array_sort(scores)))
    best, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))["s"]
    xml = v("head").startswith("<?xml") | (v("head").startswith("<") & v("tags"))
    sure = F.when(xml, "xml").when(F.coalesce("json", F.lit(False)), "json")
    margin = F.coalesce(F.try_divide(best["s"] - second, best["s"]), F.lit(0.0))
    confidence = F.bround(F.least(F.lit(1.0), F.lit(0.35) + F.lit(0.35) * F.least(best["s"], F.lit(1.0)) + F.lit(0.3) * margin), 3)
    low = best["s"] < 0.15
    return a.select(
        "device_id", "file", F.coalesce(sure, F.when(low, "unknown").otherwise(best["g"])).alias("grammar"), F.bround(best["s"], 3).alias("score"),
        F.when(sure.isNotNull(), 0.99).when(low, F.bround(best["s"], 3)).otherwise(confidence).alias("confidence"),
    )


def tree(lines: DataFrame) -> DataFrame:
    """``lines`` (device_id, file, line_no, raw, text, indent) with kind, depth and context: the headers of all
    blocks around a line, outermost first.

    In braces a block is what its braces hold; in indented files and files with markers a line's headers are the
    nearest ones above of ever smaller indent; a flat line has its path.  A statement whose block the very next
    line opens is a ``block_open``.  Lines of XML and JSON have no context.  Files without any text are ``unknown``.
    """
    of = grammar(lines).select("device_id", "file", "grammar")
    rows = lines.join(of, ["device_id", "file"], "left").select(*(F.col(f"`{c}`") for c in lines.columns), F.coalesce("grammar", F.lit("unknown")).alias("grammar"))
    schema = StructType([*lines.schema.fields]).add("kind", StringType()).add("depth", IntegerType()).add("context", ArrayType(StringType()))
    return rows.repartition("device_id", "file").sortWithinPartitions("device_id", "file", "line_no").mapInArrow(_walk, schema)
