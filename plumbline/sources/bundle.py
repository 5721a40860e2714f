"""Configuration bundles: files of devices, their roles and their lines.

Files are read by Spark's binary source, so any store works; the device of a file follows from its
path.  Directories of directories give a device per subdirectory; loose files group by the part of
their name before the first dot; a directory with at most one configuration is one device.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.tables import stage_dir

#: Fixed: suffixes that are read, fragments of names that mark show output, and limits.
SUFFIXES = [".cfg", ".conf", ".config", ".txt", ".log", ".xml", ".json", ".rsc", ".boot", ".set", ""]
SHOW = ["show-version", "show_version", "showversion", "version", "inventory", "sysinfo"]
MOST_BYTES, MOST_MEMBERS, MOST_RATIO = 64 << 20, 2000, 200

#: What ends a line, as Python's splitlines has it.
LINE_END = "\\r\\n|[\\n\\r\\u000B\\u000C\\u001C-\\u001E\\u0085\\u2028\\u2029]"


class BundleError(ValueError):
    """A bundle that can't be read safely."""


def check_archive(path: str | BinaryIO) -> list[str]:
    """Names of a zip archive's files; refuses rather than repairs."""
    with zipfile.ZipFile(path) as archive:
        members = archive.infolist()
        if len(members) > MOST_MEMBERS:
            raise BundleError(f"{len(members)} members")
        for m in members:
            name = m.filename.replace("\\", "/")
            if name.startswith("/") or ".." in name.split("/") or name[1:2] == ":":
                raise BundleError(f"unsafe path {name!r}")
            if (m.external_attr >> 16) & 0o170000 == 0o120000:
                raise BundleError(f"link {name!r}")
            if m.file_size > MOST_BYTES or m.file_size > MOST_RATIO * max(1, m.compress_size):
                raise BundleError(f"{name!r} inflates too far")
        return [m.filename for m in members if not m.is_dir()]


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["archive", "path", "content", "error"]
    for batch in batches:
        for name, content in zip(batch["archive"], batch["content"], strict=True):
            try:
                held = io.BytesIO(bytes(content or b""))
                names = check_archive(held)
                with zipfile.ZipFile(held) as archive:
                    for member in names:  # one member in memory at a time
                        yield pd.DataFrame([(name, member.replace("\\", "/"), archive.read(member), None)], columns=columns)
            except (BundleError, zipfile.BadZipFile, zlib.error, RuntimeError) as e:
                yield pd.DataFrame([(name, None, None, str(e))], columns=columns)


def unpacked(archives: DataFrame) -> DataFrame:
    """archive, path, content, error: the files of many zip archives (archive, content), each unpacked by one task.

    An archive that is null, damaged, locked or unsafe (``check_archive``) is one row with ``error`` and leaves the
    others alone; a damaged member ends its archive there, with such a row.  An empty archive gives no rows."""
    return archives.select("archive", "content").mapInPandas(_unpack, "archive string, path string, content binary, error string")


def bundles(archives: DataFrame) -> DataFrame:
    """archive, device_id, file, role, text: the source files of many archives, each with folders of devices.

    A file outside of folders belongs to the device of its name up to the first dot."""
    files = unpacked(archives).where("error is null")
    name = F.element_at(F.split("path", "/"), -1)
    deep = F.contains("path", F.lit("/"))
    device = F.when(deep, F.split_part("path", F.lit("/"), F.lit(1))).otherwise(F.split_part("path", F.lit("."), F.lit(1)))
    kept = files.where(suffix_of(name).isin(*SUFFIXES))
    return kept.select("archive", device.alias("device_id"), F.when(deep, F.regexp_replace("path", "^[^/]*/", "")).otherwise(F.col("path")).alias("file"), role_of(name).alias("role"), decoded(F.col("content")).alias("text"))


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 with or without a mark, else Latin-1."""
    utf8 = F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")
    return F.when(F.is_valid_utf8(content.cast("string")), utf8).otherwise(F.decode(content, "ISO-8859-1"))


def suffix_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?:^|[^.])(\.[^./]*)$", 1))


def role_of(name: Column) -> Column:
    low = F.lower(name)
    hit = F.lit(False)
    for part in SHOW:
        hit = hit | F.contains(low, F.lit(part))
    return F.when(hit, "show_output").otherwise("config")


def source_files(raw: DataFrame) -> DataFrame:
    """device_id, file, role, text of ``raw`` (path relative to the bundle, content).

    Rows with other suffixes are left out; one over the size limit fails the read.  Repeated paths stay
    repeated.
    """
    name = F.element_at(F.split("path", "/"), -1)
    large = F.length("content") > MOST_BYTES
    content = F.when(large, F.raise_error(F.concat(F.col("path"), F.lit(f" is larger than {MOST_BYTES} bytes"))).cast("binary")).otherwise(F.col("content"))
    kept = raw.where(suffix_of(name).isin(*SUFFIXES)).withColumn("content", content)
    parts = F.split("path", "/")
    kept = kept.select("path", decoded(F.col("content")).alias("text"), name.alias("name"), F.when(F.size(parts) > 1, parts[0]).alias("folder"))
    kept = kept.withColumn("role", role_of(F.col("name")))
    # loose files are one device if at most one of them is a configuration and there are no folders
    counted = raw.where(suffix_of(name).isin(*SUFFIXES)).agg(F.count_if((F.size(parts) <= 1) & (role_of(name) == "config")).alias("n_configs"), F.max(F.size(parts) > 1).alias("any_folder"))
    kept = kept.crossJoin(F.broadcast(counted))  # one row
    single = F.col("folder").isNull() & (F.col("n_configs") <= 1) & ~F.col("any_folder")
    stem = F.split_part("name", F.lit("."), F.lit(1))
    device = F.when(F.col("folder").isNotNull(), F.col("folder")).when(single, F.lit("device")).otherwise(stem)
    file = F.when(F.col("folder").isNotNull(), F.regexp_replace("path", "^[^/]*/", "")).otherwise(F.col("path"))
    return kept.select(device.alias("device_id"), file.alias("file"), "role", "text")


def _status(spark: SparkSession, path: str):  # noqa: ANN202
    """The qualified path and whether it is a folder; a missing one is refused."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(place):
        raise BundleError(f"{path} isn't there")
    return system.makeQualified(place).toString().rstrip("/"), system.getFileStatus(place).isDirectory()


def relative(root: str) -> Column:
    """A file's path below ``root``, which is qualified."""
    return F.substring("path", len(root) + 2, 1 << 30)


def binary_files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))


def extracted(spark: SparkSession, path: str) -> str:
    """A folder with the members of a zip archive that is safe to unpack."""
    from pyarrow import fs

    names = check_archive(path)
    folder = stage_dir(spark, "archive")
    system, root = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
    with zipfile.ZipFile(path) as archive:
        for name in names:
            target = f"{root}/{name.replace(chr(92), '/')}"
            system.create_dir(posixpath.dirname(target), recursive=True)
            with archive.open(name) as source, system.open_output_stream(target) as out:
                while block := source.read(1 << 20):
                    out.write(block)
    return folder


def load(spark: SparkSession, path: str) -> DataFrame:
    """Source files of a folder, of one file or of a zip archive (any file system Spark reads; archives are
    unpacked by the driver and so must be where it can open them).  A missing or empty target is refused."""
    if path.endswith(".zip"):
        path = extracted(spark, path)
    root, folder = _status(spark, path)
    if folder:
        raw = binary_files(spark, root).select(relative(root).alias("path"), "content")
    else:
        raw = binary_files(spark, root).select(F.lit(posixpath.basename(root)).alias("path"), "content")
    name = F.element_at(F.split("path", "/"), -1)
    if raw.where(suffix_of(name).isin(*SUFFIXES)).select("path").isEmpty():
        raise BundleError(f"{path} holds no configuration")
    files = source_files(raw)
    if not folder:
        files = files.withColumn("device_id", F.split_part("file", F.lit("."), F.lit(1)))
    return files


def lines(files: DataFrame) -> DataFrame:
    """device_id, file, role, line_no, raw, text (trimmed), indent (leading spaces).

    A null text has no lines; neither has an empty one; an ending line end starts no further line.
    """
    pieces = F.split("text", LINE_END)
    whole = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    return files.select("device_id", "file", "role", F.posexplode(whole).alias("pos", "raw")).select(
        "device_id",
        "file",
        "role",
        (F.col("pos") + 1).alias("line_no"),
        "raw",
        F.regexp_replace("raw", r"^\s+|\s+$", "").alias("text"),
        (F.length("raw") - F.length(F.ltrim("raw"))).alias("indent"),
    )
