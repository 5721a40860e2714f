"""Audits of configurations as they arrive: a file stream, one audit per batch, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans import audit, rules
from plumbline.sources import bundle


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files below ``path`` (device folders)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", "true").load(path)


def run(spark: SparkSession, path: str, out: str, checkpoint: str, ruleset: list[rules.Rule] | None = None):
    """Audit what is new and stop; findings of batch n replace any earlier try of batch n.

    A device whose folder has a new file is audited with all its files, also those of earlier batches, so
    no device is ever audited in part.
    """
    root, _ = bundle._status(spark, path)

    def one(batch: DataFrame, number: int) -> None:
        fresh = batch.select(bundle.relative(root).alias("path")).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("device")).distinct()
        devices = [r.device for r in fresh.collect()]  # folders of one batch, whose size the stream bounds
        if not devices:
            return
        raw = bundle.binary_files(spark, *(f"{root}/{d}" for d in devices)).select(bundle.relative(root).alias("path"), "content")
        result = audit.run(bundle.source_files(raw), ruleset)
        result.findings.write.mode("overwrite").parquet(f"{out}/findings/batch={number}")
        result.summary().write.mode("overwrite").parquet(f"{out}/summary/batch={number}")
        result.discard()

    return arrivals(spark, path).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
