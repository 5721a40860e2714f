from __future__ import annotations

import io
import zipfile

from plumbline.sources import bundle


def packed(members: dict[str, bytes]) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, body in members.items():
            archive.writestr(name, body)
    return held.getvalue()


def test_archives_unpacked_by_executors(spark):
    good = packed({"core/running.cfg": b"hostname core\n", "core/show-version.txt": "naïve".encode("latin-1"), "loose.cfg": b"", "core/x.png": b"-", "core/deep/er/a.conf": b"z"})
    broken = bytearray(packed({"a.cfg": bytes(range(256)) * 4}))
    broken[40:60] = b"\xff" * 20
    rows = [("good", good, 1), ("good", good, 1), ("empty", packed({}), 1), ("null", None, 1), ("none", b"", 1), ("cut", good[:50], 1), ("broken", bytes(broken), 1), ("up", packed({"a/../../b.cfg": b"x"}), 1), ("root", packed({"/b.cfg": b"x"}), 1), ("big", packed({"b.cfg": b"0" * 3_000_000}), 1)]
    df = spark.createDataFrame(rows, "archive string, content binary, path int")
    made = bundle.unpacked(df).collect()
    assert {r.archive for r in made if r.error} == {"null", "none", "cut", "broken", "up", "root", "big"} and {r.archive for r in made if r.path} == {"good"}
    assert sum(r.path is not None for r in made) == 10
    got = sorted(tuple(r)[1:] for r in bundle.bundles(df.dropDuplicates(["archive"])).collect())
    assert got == [("core", "deep/er/a.conf", "config", "z"), ("core", "running.cfg", "config", "hostname core\n"), ("core", "show-version.txt", "show_output", "naïve"), ("loose", "loose.cfg", "config", "")]
    assert bundle.bundles(df.limit(0)).count() == 0


def test_folders_are_written_by_tasks(spark, tmp_path):
    """Files in folders of their own, from several tasks; the bundle reads them back and passes over the sink's signs."""
    from pyspark.sql import functions as F

    from plumbline.sources import artefacts

    k = F.col("id").cast("string")
    rows = spark.range(60).repartition(3).select(F.concat(F.lit("dev"), k).alias("folder"), F.explode(F.array(F.lit("a.cfg"), F.lit("show-version.txt"), F.lit("x.png"))).alias("name"), F.concat(F.lit("\ufeffé"), k).alias("value"))
    artefacts.write_folders(rows, f"file://{tmp_path}/devices")
    assert (tmp_path / "devices" / "dev7" / "a.cfg").read_text() == "\ufeffé7" and not (tmp_path / "devices" / "_pending").exists()
    got = {tuple(r) for r in bundle.load(spark, f"file://{tmp_path}/devices").collect()}
    assert got == {(f"dev{k}", f, r, f"é{k}") for k in range(60) for f, r in (("a.cfg", "config"), ("show-version.txt", "show_output"))}


def test_small_files_are_dealt_out(spark, tmp_path):
    """A small file is one task's when read; its rows are made more of on all cores."""
    from plumbline import rendered

    spark.range(50).selectExpr("id AS s_suppkey", "id % 25 AS s_nationkey", "'n' AS s_name").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    assert rendered.devices(spark, str(tmp_path), False).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
