"""What the operators of this package share: scratch tables, folds and text bytes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where that setting is absent, a local session takes a temporary folder, and one on a cluster fails.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _OWN.setdefault("root", tempfile.mkdtemp(prefix="plumbline-"))
    return f"{root.rstrip('/')}/plumbline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "none") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and a lost executor
    costs a reread instead of a recomputation.

    These tables are mostly hashes and ids, which don't compress, and a codec per small file costs
    executors memory outside of the heap; tables of texts ask for a codec.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return a worker's free memory to the system at the end of a task: the worker lives on, idle."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library keeps its own counsel
        pass


#: Rows of an Arrow batch: texts are whole, so fewer rows than Spark's default keep a batch small.
BATCH_ROWS = 2000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the registered queries; Arrow batches are made smaller unless the user has set their size."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(name: str = "text") -> Column:
    """The whole text as UTF-8 bytes; a null text is an empty one."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def fold_of(modulus: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of a table, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or that name with a number if the table has it already."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}{k}" for k in range(len(taken) + 1))) if n.lower() not in taken)


def over_text(df: DataFrame, run, added: list[StructField] = []) -> DataFrame:  # noqa: B006
    """``df`` after an Arrow function of all its columns and the text's bytes, the last one; it returns the
    columns, some rows of them, and the ``added`` ones.  Inside columns have plain names, so any name passes."""
    slots = [f"c{k}" for k in range(len(df.columns))]
    rows = df.select(*own_columns(df), text_bytes().alias(free_name(df, "text_bytes"))).toDF(*slots, "bytes")
    fields = [StructField(s, f.dataType) for s, f in zip(slots, df.schema.fields, strict=True)]
    return rows.mapInArrow(run, StructType([*fields, *added])).toDF(*df.columns, *(f.name for f in added))
