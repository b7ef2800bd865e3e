"""Files that a repository tracks, as a data source: partitions are planned from the repository's index, so untracked files never enter a plan.

    tracked_files(spark, root).where("size < 1000")

The index names each file's size, so sizes are pruned and partitions balanced before any file is opened. Files over
`most` bytes and those with the ending of a binary format are listed without content, as are links, submodules and files
that are gone from the working tree. Without a repository all files below the root count, but for a few folders.
Executors open the files by their path: on a cluster the root has to be a shared folder.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

from .scratch import ship

# Endings of files without text, the largest text file, folders that count for nothing outside of a repository.
BINARY = re.compile(r"\.(?:pdf|zip|png|jpg|jpeg|gif|webp|mp4|mov)$", re.I)
MOST = 2_000_000
SKIPPED = {".git", "node_modules", "runs", "predictions"}
#: Bytes of files in a partition, and files.
PARTITION, FILES = 8 << 20, 2000
REGULAR = 0o100000


@dataclass(frozen=True)
class Entry:
    path: str
    size: int
    mode: int


def git_folder(root: str) -> str | None:
    """The folder with the index: .git, or what a file of that name points to."""
    at = os.path.join(root, ".git")
    if os.path.isfile(at):
        with open(at, encoding="utf-8") as f:
            at = os.path.join(root, f.read().partition("gitdir:")[2].strip())
    return at if os.path.exists(os.path.join(at, "index")) else None


def read_index(data: bytes, digest: int = 20) -> Iterator[Entry]:
    """Entries of an index of version 2 to 4, each path once (of a merge the first stage)."""
    if data[:4] != b"DIRC":
        raise ValueError("not an index")
    version, n = int.from_bytes(data[4:8], "big"), int.from_bytes(data[8:12], "big")
    if version not in (2, 3, 4):
        raise ValueError(f"index of version {version}")
    at, last = 12, b""
    for _ in range(n):
        begin = at
        mode, size = (int.from_bytes(data[at + k : at + k + 4], "big") for k in (24, 36))
        at += 40 + digest
        flags = int.from_bytes(data[at : at + 2], "big")
        at += 4 if flags & 0x4000 else 2
        if version == 4:  # what the path shares with the one before is given as a length to cut off
            cut = data[at] & 127
            while data[at] & 128:
                at += 1
                cut = (cut + 1 << 7) | data[at] & 127
            end = data.index(b"\0", at + 1)
            name, at = last[: len(last) - cut] + data[at + 1 : end], end + 1
        else:
            end = data.index(b"\0", at)
            name = data[at:end]
            at = begin + (end - begin) // 8 * 8 + 8
        if name != last:
            yield Entry(name.decode("utf-8", "surrogateescape"), size, mode)
        last = name


def walk(root: str) -> Iterator[Entry]:
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if n not in SKIPPED)
        for f in sorted(files):
            at = os.path.join(folder, f)
            if os.path.isfile(at) and not os.path.islink(at):
                yield Entry(os.path.relpath(at, root).replace(os.sep, "/"), os.path.getsize(at), REGULAR)


def entries(root: str) -> list[Entry]:
    folder = git_folder(root)
    if folder is None:
        return list(walk(root))
    shared = folder
    if os.path.exists(os.path.join(folder, "commondir")):
        with open(os.path.join(folder, "commondir"), encoding="utf-8") as f:
            shared = os.path.join(folder, f.read().strip())
    config = os.path.join(shared, "config")
    wide = False
    if os.path.exists(config):
        with open(config, encoding="utf-8", errors="replace") as f:
            wide = re.search(r"(?im)^\s*objectformat\s*=\s*sha256\s*$", f.read()) is not None
    with open(os.path.join(folder, "index"), "rb") as f:
        return list(read_index(f.read(), 32 if wide else 20))


@dataclass
class Files(InputPartition):
    """Entries that one task opens."""

    def __init__(self, own: list[Entry]):
        super().__init__(0)
        self.own = own


class Reader(DataSourceReader):
    def __init__(self, root: str, most: int):
        self.root, self.most, self.tests = root, most, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Tests on path and size that the index answers; the others are left to Spark."""
        made = {
            EqualTo: lambda a, b: a == b, StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b),
            LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
        }
        for f in filters:
            if type(f) in made and f.attribute in (("path",), ("size",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f
        self.made = {k.__name__: v for k, v in made.items()}

    def holds(self, e: Entry) -> bool:
        return all(self.made[kind.__name__](getattr(e, name), value) for name, kind, value in self.tests)

    def partitions(self) -> list[Files]:
        out, own, size = [], [], 0
        for e in entries(self.root):
            if not self.holds(e):
                continue
            if own and (size + e.size > PARTITION or len(own) >= FILES):
                out.append(Files(own))
                own, size = [], 0
            own.append(e)
            size += e.size if e.size <= self.most else 0
        return [*out, Files(own)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for e in partition.own:
            yield e.path, e.size, e.mode, content(self.root, e, self.most)


def content(root: str, e: Entry, most: int) -> str | None:
    """The text of a file as it stands in the working tree, or null."""
    at = os.path.join(root, e.path)
    if e.mode & 0o170000 != REGULAR or e.size > most or BINARY.search(e.path) or os.path.islink(at) or not os.path.isfile(at) or os.path.getsize(at) > most:
        return None
    with open(at, "rb") as f:
        return f.read().decode("utf-8", "replace")


class TrackedFiles(DataSource):
    """spark.read.format("tracked_files").load(root); option `most`: the largest file that is read."""

    @classmethod
    def name(cls) -> str:
        return "tracked_files"

    def schema(self) -> str:
        return "path string, size long, mode int, content string"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("most", MOST)))


def tracked_files(spark: SparkSession, root: str, most: int = MOST) -> DataFrame:
    """(path, size, mode, content) of the files that the repository at root tracks."""
    ship(spark)
    spark.dataSource.register(TrackedFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tracked_files").option("most", str(most)).load(os.path.abspath(root))
