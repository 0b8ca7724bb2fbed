"""A tree of folders as a data source: ``spark.read.format("file_tree").load(uri)`` lists its files.

Each folder directly below the root is a partition, the files beside them are one more; a partition is
walked by folders, so that a listing is as wide as the root. Filters on ``mime``, ``parent``
and ``name`` are taken over: a file that they rule out never leaves the task. Any file system that
Arrow knows can hold the tree; links that lead back up are not followed twice."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from quarry.plans.fixtures import DOCX, PDF, PPTX

SCHEMA = "id string, name string, mime string, parent string, size long, modified timestamp"
# Media types by the ends of names.
TYPES = {".pdf": PDF, ".pptx": PPTX, ".docx": DOCX, ".txt": "text/plain", ".json": "application/json", ".csv": "text/csv"}
OTHER = "application/octet-stream"
_TAKEN = ("mime", "parent", "name")


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool

    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class TreeReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri, self.wanted = uri, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  (the interface's name)
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute in [(c,) for c in _TAKEN]:
                self.wanted.setdefault(f.attribute[0], []).append(values)
            else:
                yield f

    def _open(self) -> tuple[arrow.FileSystem, str]:
        return arrow.FileSystem.from_uri(self.uri)

    def partitions(self) -> list[Folder]:
        system, root = self._open()
        below = [i.path for i in system.get_file_info(arrow.FileSelector(root)) if i.type == arrow.FileType.Directory]
        return [Folder(root, False), *(Folder(p, True) for p in sorted(below))]

    def read(self, partition: Folder) -> Iterator[tuple]:
        system, root = self._open()
        todo, seen = [partition.path], set()
        while todo:
            folder = todo.pop()
            if folder in seen:
                continue
            seen.add(folder)
            for i in system.get_file_info(arrow.FileSelector(folder)):
                if i.type == arrow.FileType.Directory:
                    todo += [i.path] if partition.deep else []
                elif i.type == arrow.FileType.File and not i.base_name.startswith((".", "_")):
                    row = {"name": i.base_name, "mime": TYPES.get(posixpath.splitext(i.base_name)[1].lower(), OTHER), "parent": posixpath.relpath(folder, root)}
                    if all(row[c] in v for c, every in self.wanted.items() for v in every):
                        yield posixpath.relpath(i.path, root), row["name"], row["mime"], row["parent"], i.size, i.mtime


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        path = self.options.get("path")
        if not path:
            raise ValueError("a tree has a path")
        return TreeReader(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def tree(spark: SparkSession, uri: str) -> DataFrame:
    """(id, name, mime, parent, size, modified) of the files of a tree; a path ends in no slash."""
    spark.dataSource.register(FileTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("file_tree").load(uri)


def contents(spark: SparkSession, uri: str, files: DataFrame) -> DataFrame:
    """``files`` (id, ...) of a tree with their bytes; a file that is empty, or gone, has none."""
    root = uri.rstrip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = F.regexp_replace("path", "^file:/+", "/")
    own = F.expr(f"substr(p_, {len(root.removeprefix('file://')) + 2})")
    held = read.filter("length > 0").withColumn("p_", plain).select(own.alias("id"), "content")
    return files.join(held, "id", "left")
