"""Times of the headline queries: one JSON line on standard output.

``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the threads.  Each query runs once to compile and
once for the figure, and writes to Spark's no-op sink, so that whole results are made.  The fleet audit
is the one workload that the reference publishes a time for: 200 devices, here from six configurations.
"""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

HEADLINE = [
    "lines_explode", "coverage_by_source", "signature_score", "winner_margin_confidence", "block_context_last", "verdict_unpivot", "score_half_even", "quantifier_all",
    "evidence_window", "range_join_first", "adjacency_self_join", "drift_global", "acl_shadow", "rank_fixes", "leaf_hash", "merkle_root", "redact_email_ip", "line_shape_family", "tfidf_rank", "confusion_metrics",
]


def fleet(spark: SparkSession, devices: int):
    """Source files of a synthetic fleet."""
    from tests.fleet_configs import ALL, IOS

    rows = []
    for k in range(devices):
        name = list(ALL)[k % len(ALL)]
        text = IOS.format(name=f"core{k}", n=k % 250 + 1) if name == "ios" else ALL[name]
        rows.append((f"{name}-{k:04d}", "running", "config", text))
    return spark.createDataFrame(rows, "device_id string, file string, role string, text string")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from plumbline.catalog import QUERIES
    from plumbline.plans import audit

    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        run()
        began = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - began, 3)

    for name in HEADLINE:
        timed(name, lambda f=QUERIES[name]: f(spark, sf_dir).write.format("noop").mode("overwrite").save())
    held = {}

    def audited() -> None:
        held["audit"] = audit.run(fleet(spark, 200))
        held["audit"].summary().write.format("noop").mode("overwrite").save()

    timed("fleet_audit_200", audited)
    timed("fleet_correlation_200", lambda: held["audit"].correlations().write.format("noop").mode("overwrite").save())
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
