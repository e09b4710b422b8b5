"""A source tree as a DataFrame: spark.read.format("repository").option("root", ...).load().

The planner lists the tree once, with ignored folders pruned before they are listed and ignore files honoured, and
puts the kept files into partitions of bounded bytes; executors read the bytes. Spark's own file source would leave
out every name that begins with a dot or an underscore.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import constants as K
from ..functions.paths import IgnoreRule, ignore_rules, is_ignored
from .decode import decoded

SCHEMA = "rel string, size bigint, ext string, mtime_ms double, content string"
PARTITION_BYTES = 32 << 20


@dataclass
class Walk:
    files: list[tuple[str, int, str, float]] = field(default_factory=list)
    excluded: int = 0
    capped: bool = False
    #: How many files were left out for each reason: size, lockfile, binary, minified, ignored.
    why: Counter = field(default_factory=Counter)


def _extension(name: str) -> str:
    stem, dot, ext = name.rpartition(".")
    return f".{ext.lower()}" if dot and stem.strip(".") else ""


def _reject(name: str, ext: str, size: int, max_bytes: int | None) -> str | None:
    if max_bytes is not None and size > max_bytes:
        return "size"
    if name in K.LOCKFILES:
        return "lockfile"
    if ext in K.BINARY_EXTENSIONS:
        return "binary"
    return "minified" if name.endswith((".min.js", ".min.css")) else None


def walk(root: str, max_bytes: int | None = None, max_files: int | None = None, gitignore: bool = True, ignored: list[str] | None = None) -> Walk:
    """Kept files as (rel, size, ext, mtime in ms) and how many were left out, and why. The order is that of a stack.

    ``max_bytes`` and ``max_files`` bound a file and the list; by default nothing does.
    """
    skip = set(K.IGNORED_DIRS if ignored is None else ignored)
    top = os.path.realpath(root)
    out = Walk()
    stack: list[tuple[str, list[IgnoreRule]]] = [("", [])]
    while stack:
        folder, rules = stack.pop()
        here = os.path.join(top, folder)
        try:
            entries = sorted(os.scandir(here), key=lambda e: e.name)
        except OSError:
            continue
        if gitignore and any(e.name == ".gitignore" for e in entries):
            with open(os.path.join(here, ".gitignore"), "rb") as f:
                rules = rules + ignore_rules(decoded(f.read()), folder)
        for e in entries:
            rel = f"{folder}/{e.name}" if folder else e.name
            try:
                if e.is_symlink():
                    goal = os.path.realpath(e.path)
                    if os.path.isdir(goal) or not goal.startswith(top + os.sep):
                        continue
                if e.is_dir():
                    if e.name not in skip and not (gitignore and is_ignored(rules, rel, True)):
                        stack.append((rel, rules))
                    continue
                stat = e.stat()
            except OSError:
                continue
            ext, low = _extension(e.name), e.name.lower()
            if why := _reject(low, ext, stat.st_size, max_bytes) or ("ignored" if gitignore and is_ignored(rules, rel) else None):
                out.excluded += 1
                out.why[why] += 1
                continue
            if max_files is not None and len(out.files) >= max_files:
                out.capped = True
                return out
            out.files.append((rel, stat.st_size, ext, stat.st_mtime * 1000))
    return out


def _limits(options: dict[str, str]) -> dict:
    """Of the options maxfilebytes, maxfiles, gitignore and ignoreddirs (a comma between) what ``walk`` takes; caps only where they are asked for."""
    return {
        "max_bytes": int(options["maxfilebytes"]) if "maxfilebytes" in options else None,
        "max_files": int(options["maxfiles"]) if "maxfiles" in options else None,
        "gitignore": options.get("gitignore", "true").lower() == "true",
        "ignored": options["ignoreddirs"].split(",") if "ignoreddirs" in options else None,
    }


def left_out(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """(what, files): files kept, files excluded for each reason, and ``capped`` with 1 where the list was cut."""
    w = walk(root, **_limits(options))
    rows = [("kept", len(w.files)), ("capped", int(w.capped)), *sorted(w.why.items())]
    return spark.createDataFrame(rows, "what string, files bigint")


class _Files(InputPartition):
    def __init__(self, root: str, files: list[tuple[str, int, str, float]]):
        self.root, self.files = root, files


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["root"]
        self.limits = _limits(options)

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        own, size = [], 0
        for f in walk(self.root, **self.limits).files:
            own.append(f)
            size += f[1] + 4096
            if size >= PARTITION_BYTES:
                parts.append(_Files(self.root, own))
                own, size = [], 0
        return [*parts, _Files(self.root, own)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for rel, size, ext, mtime in partition.files:
            try:
                with open(os.path.join(partition.root, rel), "rb") as f:
                    content = decoded(f.read())
            except OSError:
                content = None  # listed, but gone or unreadable by now
            yield rel, size, ext, mtime, content


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RepositorySource)
