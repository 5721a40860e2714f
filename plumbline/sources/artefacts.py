"""A sink of named files: ``spark.dataSource.register(Files)``, then ``df.write.format("named_files")``.

Rows are (name string, value string), or (folder string, name string, value string) for files in folders of their
own; those of one name that follow each other in a task are one file, so that
a long file is a stream and never held.  Names otherwise are distinct (the last one stays).  A task writes each value under a name of its own attempt and moves it
into place, which is atomic; a task that runs again, or twice at a time, puts the same bytes there again.  So
lost executors leave no half file, and ``_SUCCESS`` appears only when all are there.  Nothing but counts goes
to the driver.  Append replaces files of the same name; overwrite empties the folder first.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

PENDING = "_pending"


class NoName(ValueError):
    """A row whose file would have no name."""


@dataclass
class Written(WriterCommitMessage):
    files: int


def file_name(name: str | None) -> str:
    """A name that stays in its folder: separators and signs that file systems dislike become %XX, and so does a
    leading dot or underscore, which readers would pass over."""
    if not name:
        raise NoName("a file needs a name")
    safe = quote(name, safe=" ._-()+=@,~")
    return f"%{ord(safe[0]):02X}{safe[1:]}" if safe[0] in "._" else safe


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or of a local path."""
    if path.startswith("file:"):  # file:/x and file:///x are the same
        path = "/" + path[5:].lstrip("/")
    disk, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return disk, root.rstrip("/")


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if schema.fieldNames() not in (["name", "value"], ["folder", "name", "value"]):
            raise ValueError("rows are (name, value) or (folder, name, value)")
        disk, root = _place(self.options["path"])
        if overwrite and disk.get_file_info(root).type != fs.FileType.NotFound:
            disk.delete_dir_contents(root)
        disk.create_dir(f"{root}/{PENDING}", recursive=True)
        return FilesWriter(self.options["path"])


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Written:
        disk, root = _place(self.path)
        pending, count = f"{root}/{PENDING}/{uuid.uuid4().hex}", 0
        made: set[str] = set()
        for name, rows in groupby(iterator, lambda row: "/".join(map(file_name, row[:-1]))):
            with disk.open_output_stream(pending) as out:
                for row in rows:
                    out.write((row["value"] or "").encode())
            folder = posixpath.dirname(name)
            if folder and folder not in made:
                disk.create_dir(f"{root}/{folder}", recursive=True)
                made = {folder}  # rows of one folder mostly follow each other
            disk.move(pending, f"{root}/{name}")
            count += 1
        return Written(count)

    def commit(self, messages: list[Written | None]) -> None:
        disk, root = _place(self.path)
        disk.delete_dir(f"{root}/{PENDING}")
        with disk.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        """Drops what is pending; files already in place are whole, but there is no ``_SUCCESS``."""
        disk, root = _place(self.path)
        disk.delete_dir(f"{root}/{PENDING}")


def write_files(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write (name, value) rows, a file each."""
    rows.sparkSession.dataSource.register(Files)
    rows.select("name", "value").write.format("named_files").mode(mode).option("path", path).save()


def write_folders(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write (folder, name, value) rows, a file each in its folder."""
    rows.sparkSession.dataSource.register(Files)
    rows.select("folder", "name", "value").write.format("named_files").mode(mode).option("path", path).save()
