"""Folder trees listed and read by tasks.

The driver lists one level: the folders below the root. Each is one task of the listing, which walks it and yields
(path, length, modified); so a tree of any size is listed by as many tasks as it has folders, and no list of
files is held anywhere. Files are then opened by the tasks that the paths are dealt to.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from reportlake.sources.files import REPORT_PATH, reports_from_files

BATCH_BYTES = 1 << 20  # bytes of files that leave together, or one file
LISTED = "path string, length long, modified timestamp"


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if ":" not in root or root.startswith("file:"):  # no address to parse: names may hold blanks and percent signs
        return fs.LocalFileSystem(), os.path.abspath(re.sub("^file:/+", "/", root))
    return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", root))


def address_start(root: str, base: str) -> str:
    """What stands before a path of the file system where Spark names the file."""
    if ":" not in root or root.startswith("file:"):
        return "file:"
    whole, base = root.rstrip("/"), base.rstrip("/")
    return whole[: len(whole) - len(base)] if whole.endswith(base) else root.split(":", 1)[0] + ":"


class Folder(InputPartition):
    """A folder to walk, or the files that lie in the root itself."""

    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.folders, self.names = options.get("folders", "*"), options.get("names", "*")

    def partitions(self) -> list[Folder]:
        where, base = opened(self.root)
        below = where.get_file_info(fs.FileSelector(base))
        deep = [Folder(i.path, True) for i in below if i.type == fs.FileType.Directory and fnmatch.fnmatchcase(i.base_name, self.folders)]
        return [Folder(base, False), *sorted(deep, key=lambda f: f.path)]

    def read(self, part: Folder) -> Iterator[pa.RecordBatch]:
        where, base = opened(self.root)
        start = address_start(self.root, base)
        todo = [part.path]
        while todo:  # folder by folder, so a task holds one folder's list
            rows = []
            for info in where.get_file_info(fs.FileSelector(todo.pop(), allow_not_found=True)):
                if info.type == fs.FileType.Directory and part.deep:
                    todo.append(info.path)
                elif info.type == fs.FileType.File and fnmatch.fnmatchcase(info.base_name, self.names):
                    rows.append((f"{start}{info.path}", info.size, info.mtime))
            if rows:
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.timestamp("us", "UTC")), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "length", "modified"])


class TreeSource(DataSource):
    """``spark.read.format("tree")``: options ``path``, ``folders`` and ``names`` (patterns of the first level and of files)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema: object) -> TreeReader:
        return TreeReader(self.options)


def tree_listing(spark: SparkSession, root: str, folders: str = "*", names: str = "*") -> DataFrame:
    """(path, length, modified) of all files below the root, empty ones too; a task for each folder below it."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("folders", folders).option("names", names).load(root)


def glob_pattern(glob: str) -> str:
    """The regular expression of a file pattern as Spark's ``pathGlobFilter`` takes it: ``* ? [] {,}`` and escapes."""
    out, at, depth = "", 0, 0
    while at < len(glob):
        sign = glob[at]
        if sign == "\\" and at + 1 < len(glob):
            at += 1
            out += re.escape(glob[at])
        elif sign == "[" and "]" in glob[at + 2 :]:
            end = glob.index("]", at + 2)
            kind = "^" if glob[at + 1] in "!^" else ""
            out += f"[{kind}{re.sub(r'([&~|[])', r'\\\1', glob[at + 1 + len(kind) : end])}]"
            at = end
        elif sign == "," and depth:
            out += "|"
        elif sign in "{}" and (sign == "{" or depth):
            depth += 1 if sign == "{" else -1
            out += "(?:" if sign == "{" else ")"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(sign) or re.escape(sign)
        at += 1
    return f"^{out}$"


def visible_files(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length, modified) of the files that Spark's sources would read below ``root``, listed by tasks.

    Like these it passes over empty files and names that begin with ``_`` or ``.``.
    """
    found = tree_listing(spark, root, "*" if recursive else "")
    _, base = opened(root)
    below = F.substr("path", F.lit(len(address_start(root, base) + base.rstrip("/")) + 1))
    named = F.substring_index("path", "/", -1).rlike(glob_pattern(glob))
    return found.filter("length > 0").filter(named & ~below.rlike(r"/([.]|_[^/=]*/|_[^/]*$)|[.]_COPYING_$"))


def with_content(listing: DataFrame, root: str, parts: int | None = None) -> DataFrame:
    """(path, length, content): the listed files, dealt to ``parts`` tasks by path and read there one by one."""
    parts = parts or int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = opened(root)
        start = address_start(root, base)
        kinds = (pa.string(), pa.int64(), pa.binary())

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "length", "content"])

        for batch in batches:
            rows, size = [], 0  # small files share a batch, whose start costs more than they do
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                with where.open_input_stream(path.removeprefix(start)) as source:
                    rows.append((path, length, source.read()))
                size += len(rows[-1][2])
                if size >= BATCH_BYTES:
                    yield packed(rows)
                    rows, size = [], 0
            if rows:
                yield packed(rows)

    return listing.select("path", "length").repartition(parts, "path").mapInArrow(read, "path string, length long, content binary")


def reports(spark: SparkSession, root: str, pattern: str = REPORT_PATH) -> DataFrame:
    """(study, text) of a tree ``p??/p*/s*.txt``; empty reports are kept, as they are listed like others."""
    return reports_from_files(with_content(tree_listing(spark, root, "p??", "s*.txt"), root), pattern)
