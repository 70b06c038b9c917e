"""Folders that are replaced as a whole: versions, of which one is published.

A writer fills a folder of its own below ``<root>/versions``, so no two drivers ever write to the same place.  Creating the empty
file ``<root>/published/<number>.<version>`` publishes it; the highest number is what readers get.  Until then, and if the
write fails, they get the version before.  All of it goes through Hadoop's FileSystem, so it works wherever Spark reads and writes.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_TURNS: dict[str, threading.Lock] = {}  # threads of one process that want the same folder do not write it twice


class Files:
    """The file system of a path."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def create(self, path: str) -> None:
        """An empty file, with the folders above it."""
        self.fs.create(self.path(path), False).close()

    def state(self, path: str) -> str:
        """Size, number of files and time of the last change of what lies at ``path``."""
        if not self.exists(path):
            return "missing"
        summary = self.fs.getContentSummary(self.path(path))
        return f"{summary.getLength()}:{summary.getFileCount()}:{self.fs.getFileStatus(self.path(path)).getModificationTime()}"


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self.files = Files(spark, self.root)

    def folder(self, version: str) -> str:
        return f"{self.root}/versions/{version}"

    def published(self) -> list[str]:
        """The published versions, the current one last."""
        return [name.split(".", 1)[1] for name in self.files.names(f"{self.root}/published")]

    def current(self) -> str | None:
        return (self.published() or [None])[-1]

    def publish(self, version: str) -> None:
        markers = self.files.names(f"{self.root}/published")
        number = int(markers[-1].split(".", 1)[0]) + 1 if markers else 1
        self.files.create(f"{self.root}/published/{number:012d}.{version}")

    def write(self, fill: Callable[[str], object], good: Callable[[str], bool] = lambda version: True) -> str | None:
        """Let ``fill`` write a new version (its name is given) and publish it if it is ``good``; the version, or None."""
        version = uuid.uuid4().hex
        try:
            fill(version)
            if not good(version):
                self.files.delete(self.folder(version))
                return None
        except BaseException:
            self.files.delete(self.folder(version))
            raise
        self.publish(version)
        return version

    def drop_old(self, keep: int = 2) -> list[str]:
        """Remove all but the last ``keep`` published versions; a reader of the one before the current is not disturbed."""
        old = self.files.names(f"{self.root}/published")[:-keep]
        for marker in old:
            self.files.delete(f"{self.root}/published/{marker}")
            self.files.delete(self.folder(marker.split(".", 1)[1]))
        return [marker.split(".", 1)[1] for marker in old]


def written_once(spark: SparkSession, root: str, write: Callable[[str], object]) -> str:
    """The folder of the version at ``root``; ``write`` fills one first if there is none.

    Drivers that find none at the same time write one each; any of them is as good as another.
    """
    versions = Versions(spark, root)
    with _TURNS.setdefault(versions.root, threading.Lock()):
        version = versions.current() or versions.write(lambda v: write(versions.folder(v)))
    return versions.folder(version)
