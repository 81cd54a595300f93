"""A Spark data source of whole source files: folders are gone through and files opened by the tasks.

Spark's own file sources leave out names that begin with an underscore and files without a byte, and both are modules of a Python package.  The driver only
divides the tree: it opens folders, breadth first, until there are enough of them for the tasks."""

from __future__ import annotations

import fnmatch
import os
import re
import sys
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders that the driver divides a tree into, and tasks that they are dealt to.
FOLDERS, TASKS = 256, 32


def local_path(path: str) -> str | None:
    """The path in the file system that driver and tasks share; null for other stores."""
    parts = urlsplit(path)
    return os.path.abspath(unquote(parts.path)) if parts.scheme == "file" else os.path.abspath(path) if parts.scheme == "" else None


def alternatives(pattern: str) -> list[str]:
    """A pattern with {a,b} as patterns without."""
    found = re.match(r"^(.*?)\{([^{}]*)\}(.*)$", pattern)
    return [a for x in found[2].split(",") for a in alternatives(found[1] + x + found[3])] if found else [pattern]


def _entries(folder: str) -> tuple[list[str], list[str]]:
    """Folders and files in a folder, by name, but those whose name begins with a dot; links to folders aren't followed."""
    with os.scandir(folder) as every:
        shown = sorted((e for e in every if not e.name.startswith(".")), key=lambda e: e.name)
        return [e.path for e in shown if e.is_dir(follow_symlinks=False)], [e.path for e in shown if e.is_file()]


class Folders(InputPartition):
    """Folders of a task; with ``deep`` what lies below them too."""

    def __init__(self, folders: list[tuple[str, bool]]) -> None:
        super().__init__(None)
        self.folders = folders


class FolderReader(DataSourceReader):
    def __init__(self, root: str, pattern: str) -> None:
        self.root = root
        self.wanted = [re.compile(fnmatch.translate(p)) for p in alternatives(pattern)]

    def partitions(self) -> list[Folders]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"no folder {self.root}")
        opened: list[tuple[str, bool]] = []
        waiting = [self.root]
        while waiting and len(waiting) + len(opened) < FOLDERS:
            folder = waiting.pop(0)
            opened.append((folder, False))
            waiting += _entries(folder)[0]
        every = opened + [(f, True) for f in waiting]
        return [Folders(every[k::TASKS]) for k in range(min(TASKS, len(every)))]

    def read(self, partition: Folders) -> Iterator[tuple[str, str]]:
        for folder, deep in partition.folders:
            waiting = [folder]
            while waiting:
                below, files = _entries(waiting.pop())
                waiting += below if deep else []
                for path in files:
                    if any(w.match(os.path.basename(path)) for w in self.wanted):
                        with open(path, "rb") as file:
                            yield f"file://{path}", file.read().decode("utf-8", "replace")


class FolderSource(DataSource):
    """Format ``source_folder``: the folder as path, option ``pattern``, such as ``*.{ts,tsx}``."""

    @classmethod
    def name(cls) -> str:
        return "source_folder"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema: object) -> FolderReader:
        return FolderReader(self.options["path"], self.options.get("pattern", "*"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no package for it


def read_folder(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, content) of the files below a folder; the path as ``file://`` and the absolute path."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("source_folder").option("pattern", pattern).load(local_path(path))
