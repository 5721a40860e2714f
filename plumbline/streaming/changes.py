"""Drift as a stream: every written audit of a device meets the last one, kept as state, and tells what moved.

State is one row per device, the time and the verdicts of its last audit, in RocksDB beside the checkpoint; it
grows with devices, not with audits.  Written audits are one row per device each, so an audit is never seen in
part.  An audit that isn't later than the last one of its device (a file read again, a late one) tells nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.operators.drift import AUDIT

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "device_id string, at timestamp, rule_id string, before string, after string, change string"


def kind(before: str, after: str) -> str:
    """How a verdict moved, as in drift between two audits."""
    if after == "fail":
        return "regression"
    return "improvement" if before == "fail" and after in ("pass", "not_applicable") else "other"


class LastVerdicts(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "tick long, verdicts string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """The audits of a device in one batch, of which there are few, in the order of their times."""
        tick, text = self.last.get() if self.last.exists() else (None, None)
        held = None if text is None else json.loads(text)
        moved = False
        for row in sorted(rows, key=lambda r: r.tick):
            if tick is not None and row.tick <= tick:
                continue
            now = json.loads(row.verdicts)
            if held is not None:
                for rule in sorted(held.keys() | now.keys()):
                    before, after = held.get(rule, "absent"), now.get(rule, "absent")
                    if before != after:
                        yield Row(device_id=key[0], at=row.at, rule_id=rule, before=before, after=after, change=kind(before, after))
            tick, held, text, moved = row.tick, now, row.verdicts, True
        if moved:
            self.last.update((tick, text))

    def close(self) -> None:
        pass


def session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that this operator needs: the user's settings stay as they are."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return own


def written_audits(spark: SparkSession, path: str, at: Column | None = None) -> DataFrame:
    """A stream of device_id, at, verdicts of the audits that are written below ``path`` as JSON, with folders of
    any depth; the time of an audit is that of its file.  Rules out of scope, as in a report, are absent."""
    rows = spark.readStream.schema(AUDIT).option("recursiveFileLookup", "true").json(path)
    pairs = F.concat(
        F.transform(F.coalesce("findings", F.array().cast("array<struct<rule_id:string,verdict:string>>")), lambda f: F.struct(f["rule_id"].alias("k"), f["verdict"].alias("v"))),
        F.transform(F.coalesce("passed", F.array().cast("array<string>")), lambda r: F.struct(r.alias("k"), F.lit("pass").alias("v"))),
    )
    return rows.select("device_id", (F.col("_metadata.file_modification_time") if at is None else at).alias("at"), F.map_from_entries(pairs).alias("verdicts"))


def changes(audits: DataFrame) -> DataFrame:
    """device_id, at, rule_id, before, after, change of a stream of audits (device_id, at, verdicts), in a session
    of ``session``.  A device's first audit tells nothing; a rule that comes or goes is ``absent`` on one side; of
    two audits of one time one counts.  Audits without a device, a time or verdicts are passed over."""
    whole = audits.where("device_id is not null and at is not null and verdicts is not null").withColumns({"tick": F.unix_micros("at"), "verdicts": F.to_json("verdicts")})
    return whole.groupBy("device_id").transformWithState(LastVerdicts(), CHANGE, "append", "none")


def run(found: DataFrame, out: str, checkpoint: str):
    """Tell what is new and stop: batch n is a folder of its own and replaces any earlier try of batch n, so that a
    restart tells each change once."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return found.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def told(spark: SparkSession, out: str) -> DataFrame:
    """All changes that were told so far."""
    return spark.read.schema(CHANGE).option("recursiveFileLookup", "true").parquet(out)
