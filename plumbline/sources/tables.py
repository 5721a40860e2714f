"""Stage tables: long plans are cut where a table is used more than once or lineage grows."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_ACTIVE = threading.local()


class NoSharedFolder(RuntimeError):
    """A cluster without ``spark.checkpoint.dir``: a local folder would not be seen by all."""


def stage_dir(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors both write: below ``spark.checkpoint.dir``.  Where that is
    unset, a local session takes a temporary folder, and one on a cluster fails."""
    path = f"{_root(spark)}/stages/{name}-{uuid.uuid4().hex}"
    for made in getattr(_ACTIVE, "lists", ()):
        made.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that this thread stages within, also those that a later step replaces."""
    lists = _ACTIVE.__dict__.setdefault("lists", [])
    made: list[str] = []
    lists.append(made)
    try:
        yield made
    finally:
        lists[:] = [x for x in lists if x is not made]


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes all that is staged within, whether the work ends well or not."""
    with recorded() as made:
        try:
            yield
        finally:
            delete(spark, made)


def delete(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders; those that are gone already are passed over."""
    for folder in folders:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _OWN.setdefault("root", tempfile.mkdtemp(prefix="plumbline-stages-"))
    return root.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back."""
    path = stage_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys`` over all cores: a small file is one task's, however much is made of its rows."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def discard(df: DataFrame) -> None:
    """Delete the folders of a staged table, which is not to be read again; other files stay."""
    spark = df.sparkSession
    inside = f"{_root(spark)}/stages/".split(":", 1)[-1].lstrip("/")
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    delete(spark, [f for f in folders if inside in f])
