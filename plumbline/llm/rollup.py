"""Token counts kept up to date by deltas.

A change carries a before and an after image (either may be null): an insert has only an after, a
delete only a before, a revised count both.  A batch is folded to signed sums per (source, lang,
tokenizer_version) and committed as one Parquet folder ``batch=<id>`` that is renamed into place, so a
batch counts once however often it is sent, and one that failed half way counts not at all.  Totals
are sums over committed batches; ``compact`` folds them into one base, which remembers its batches.

A tokenizer version is a name and a way to count: a pattern whose matches are tokens (``counted``), or a
vocabulary file (``counted_by_vocabulary``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer_version"]
IMAGE = "struct<source:string,lang:string,tokenizer_version:string,n_tokens:long>"
SCHEMA = "source string, lang string, tokenizer_version string, docs long, tokens long"

#: Words between the six white-space characters, and runs of digits, lower-case letters and bytes
#: beyond ASCII once A-Z are lower-cased: the two tokenizer versions of the query.
SPACES, LETTERS = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def counted(pattern: str, text: str = "text") -> Column:
    """How many tokens a text has; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(pattern)), F.lit(0)).cast("long")


def counted_by_vocabulary(docs: DataFrame, path: str | None = None, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens that the vocabulary file gives each text; null texts have none.

    A column of that name is replaced.  A scan without shuffle; words that repeat are encoded once a worker.
    """
    from plumbline.llm.bpe import encoder, tokenizer_path
    from plumbline.llm.common import text_bytes

    own = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = encoder(path or tokenizer_path())
        for batch in batches:
            counts = [len(reader.encode(x.as_py())[0]) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*batch.schema.names[:-1], name])

    schema = own.schema.add(name, "long")
    return own.withColumn("__text_bytes", text_bytes(text)).mapInArrow(run, schema)


def image(source: str | Column, lang: str | Column, version: Column, n: Column) -> Column:
    """An image; it is never null itself, also if its parts are."""
    return F.struct(F.col(source) if isinstance(source, str) else source, F.col(lang) if isinstance(lang, str) else lang, version, n).cast(IMAGE)


def none() -> Column:
    return F.lit(None).cast(IMAGE)


def folded(changes: DataFrame) -> DataFrame:
    """Signed sums of ``changes`` (before, after); rows whose sums are all zero are left out."""
    signed = changes.select(F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("x")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("x")))).alias("e")).select("e.*")
    rows = signed.where("x is not null").select("sign", "x.*")
    sums = rows.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0))).cast("long").alias("tokens"))
    return sums.where("docs <> 0 or tokens <> 0")


class Rollup:
    """Totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def _names(self, prefix: str) -> list[str]:
        if not self._fs.exists(self._path(self.path)):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))) if n.startswith(prefix))

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest base and the batches that it holds."""
        bases = self._names("base=")
        if not bases:
            return None, set()
        held = self.spark.read.schema("batch string").json(f"{self.path}/{bases[-1]}/batches")
        return bases[-1], {r.batch for r in held.collect()}

    def committed(self) -> list[str]:
        return sorted({n.removeprefix("batch=") for n in self._names("batch=")} | self._base()[1])

    def _publish(self, written: str, name: str) -> bool:
        """Rename into place; false if another writer came first."""
        target = self._path(f"{self.path}/{name}")
        if self._fs.exists(target):
            self._fs.delete(self._path(written), True)
            return False
        done = self._fs.rename(self._path(written), target)
        if not done:
            self._fs.delete(self._path(written), True)
        return done

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Fold and commit a batch; false, and nothing read, if it was committed before."""
        if not batch or "/" in batch:
            raise ValueError("a batch needs a name without slashes")
        if self._exists(f"batch={batch}") or batch in self._base()[1]:
            return False
        pending = f"{self.path}/_pending-{uuid.uuid4().hex}"
        folded(changes).write.parquet(pending)
        return self._publish(pending, f"batch={batch}")

    def _deltas(self) -> tuple[DataFrame, list[str]]:
        """Rows of the newest base and of the batches since, and the names of all batches in them."""
        base, held = self._base()
        fresh = [n for n in self._names("batch=") if n.removeprefix("batch=") not in held]
        folders = [f"{self.path}/{n}" for n in fresh] + ([f"{self.path}/{base}/totals"] if base else [])
        if not folders:
            return self.spark.createDataFrame([], SCHEMA), []
        return self.spark.read.schema(SCHEMA).parquet(*folders), sorted(held | {n.removeprefix("batch=") for n in fresh})

    @staticmethod
    def _summed(deltas: DataFrame) -> DataFrame:
        return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, docs, tokens; groups that came to nothing are left out."""
        return self._summed(self._deltas()[0])

    def compact(self) -> None:
        """Fold the batches committed so far into a new base.

        Its totals and its names come from one listing: a batch that is committed meanwhile is in
        neither, and counts from its own folder.
        """
        deltas, batches = self._deltas()
        if not batches:
            return
        pending = f"{self.path}/_pending-{uuid.uuid4().hex}"
        self._summed(deltas).write.parquet(f"{pending}/totals")
        self.spark.createDataFrame([(b,) for b in batches], "batch string").write.json(f"{pending}/batches")
        number = len(self._names("base="))
        self._publish(pending, f"base={number:012d}")


def replay(docs: DataFrame, path: str) -> Rollup:
    """The life of a corpus in four batches, one of them sent twice.

    All rows arrive with counts of the first tokenizer; English rows are revised to the second; rows of
    fewer than ten words are deleted; the revision is sent again.
    """
    from plumbline.llm.common import written

    rows = written(docs.select("source", "lang", counted(SPACES).alias("n1"), counted(LETTERS).alias("n2")), "counts")
    first = image("source", "lang", F.lit("words-1"), F.col("n1"))
    second = image("source", "lang", F.lit("words-2"), F.col("n2"))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    rollup = Rollup(docs.sparkSession, path)
    revised = rows.where(english).select(first.alias("before"), second.alias("after"))
    rollup.commit("0001-arrivals", rows.select(none().alias("before"), first.alias("after")))
    rollup.commit("0002-revised", revised)
    rollup.commit("0003-deleted", rows.where("n1 < 10").select(F.when(english, second).otherwise(first).alias("before"), none().alias("after")))
    rollup.commit("0002-revised", revised)
    return rollup


ORACLE = r"""
SELECT source, lang, tokenizer_version, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens
FROM (
  SELECT source, lang, n1,
         CASE WHEN lang = 'en' THEN 'words-2' ELSE 'words-1' END AS tokenizer_version,
         CASE WHEN lang = 'en' THEN n2 ELSE n1 END AS n
  FROM (
    SELECT source, lang,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n1,
           coalesce(len(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 0) AS n2
    FROM documents
  )
)
WHERE n1 >= 10
GROUP BY source, lang, tokenizer_version
"""
