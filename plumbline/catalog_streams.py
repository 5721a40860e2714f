"""Queries that run as streams: the tables arrive in parts, and each part is a run that goes on from the last."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.registry import query, table
from plumbline.sources.tables import stage_dir
from plumbline.streaming import changes

_MOVED = "CASE WHEN after = 'fail' THEN 'regression' WHEN before = 'fail' AND after IN ('pass', 'not_applicable') THEN 'improvement' ELSE 'other' END"


@query(f"""WITH a AS (SELECT o_custkey AS c, o_orderdate AS d, CASE max(o_orderstatus) WHEN 'F' THEN 'fail' WHEN 'O' THEN 'pass' ELSE 'unknown' END AS s,
        CASE WHEN month(o_orderdate) % 3 = 0 THEN 'absent' WHEN min(o_orderpriority) < '3' THEN 'fail' ELSE 'pass' END AS u FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY o_custkey, o_orderdate),
    p AS (SELECT c, d, 'settled' AS rule_id, lag(s) OVER (PARTITION BY c ORDER BY d) AS before, s AS after FROM a
        UNION ALL SELECT c, d, 'urgent', lag(u) OVER (PARTITION BY c ORDER BY d), u FROM a)
    SELECT 'c' || c AS device_id, strftime(d, '%Y-%m-%d') AS day, rule_id, before, after, {_MOVED} AS change FROM p WHERE before <> after""")
def streamed_changes(spark, sf_dir):
    """Customers as devices and their days with orders as audits, which arrive in three runs of one stream: what a
    run tells depends on state that an earlier one left."""
    day = F.col("o_orderdate").cast("timestamp")
    settled = F.when(F.max("o_orderstatus") == "F", "fail").when(F.max("o_orderstatus") == "O", "pass").otherwise("unknown")
    urgent = F.when(F.min("o_orderpriority") < "3", "fail").otherwise("pass")
    rows = table(spark, sf_dir, "orders").where("o_custkey is not null and o_orderdate is not null").groupBy("o_custkey", day.alias("at")).agg(settled.alias("s"), urgent.alias("u"))
    verdicts = F.when(F.month("at") % 3 == 0, F.create_map(F.lit("settled"), F.col("s"))).otherwise(F.create_map(F.lit("settled"), F.col("s"), F.lit("urgent"), F.col("u")))
    audits = rows.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("device_id"), "at", verdicts.alias("verdicts"))
    path, own = stage_dir(spark, "arriving"), changes.session(spark)
    for k, part in enumerate(("year(at) < 1997", "year(at) between 1997 and 1998", "year(at) > 1998")):
        audits.where(part).write.parquet(f"{path}/in/{k}")
        arriving = own.readStream.schema(audits.schema).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        changes.run(changes.changes(arriving), f"{path}/out", f"{path}/state").awaitTermination()
    found = changes.told(spark, f"{path}/out")
    return found.select("device_id", F.date_format("at", "yyyy-MM-dd").alias("day"), "rule_id", "before", "after", "change")
