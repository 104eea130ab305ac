"""Trees of files as a data source: spark.read.format("source_tree") and spark.readStream.

A reader's partitions are directories. The driver only opens directories until there are enough
of them to go round; all below is listed and read in tasks, so no list of paths is ever whole in
one place. Ignored directories are not entered, and what is asked of paths, by options, is
answered while listing, before a file is opened. It is no pushFilters(): Spark keeps what that
takes with the relation, so two filters on one frame would answer each other's. The stream's offsets are
commits: a batch has the files that changed from one to the next.
"""

from __future__ import annotations

import json
import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from corroba.operators.ignore import IgnoreRules
from corroba.operators.workers import know_package

SCHEMA = "path string, parent string, name string, depth int, extension string, size_bytes long, content binary"
CHANGES = "path string, commit string, change string, content binary"
#: Directories that the driver opens a tree to, and bytes of contents sent on at a time.
SPREAD, BATCH_BYTES = 64, 8 << 20
_FIELDS = pa.schema([("path", pa.string()), ("parent", pa.string()), ("name", pa.string()), ("depth", pa.int32()), ("extension", pa.string()), ("size_bytes", pa.int64()), ("content", pa.binary())])


@dataclass
class Directory(InputPartition):
    """A directory below the root (empty: the root itself), with all below it or its own files only."""

    prefix: str
    deep: bool


def facts(path: str) -> dict[str, object]:
    """What a path tells by itself."""
    parent, _, name = path.rpartition("/")
    extension = re.search(r"(\.[^.]+)$", name)
    return {"path": path, "parent": parent, "name": name, "depth": path.count("/"), "extension": extension[1].lower() if extension else ""}


class _Tree:
    """Listing below a root on any file system that Arrow opens."""

    def __init__(self, root: str, patterns: list[str]):
        from pyarrow import fs

        self.system, self.base = fs.FileSystem.from_uri(root) if re.match("[a-z0-9]+:", root) else (fs.LocalFileSystem(), root)
        self.base = self.base.rstrip("/")
        self.rules = IgnoreRules(patterns)

    def entries(self, prefix: str) -> tuple[list[str], list[tuple[str, int]]]:
        """(directories, files with sizes) right below a prefix, relative to the root, sorted, none ignored."""
        from pyarrow import fs

        folders, files = [], []
        for info in self.system.get_file_info(fs.FileSelector(f"{self.base}/{prefix}".rstrip("/"))):
            path = f"{prefix}/{info.base_name}" if prefix else info.base_name
            is_dir = info.type == fs.FileType.Directory
            if self.rules.is_ignored(path, is_dir):
                continue
            if is_dir:
                folders.append(path)
            else:
                files.append((path, info.size or 0))
        return sorted(folders), sorted(files)

    def open(self, path: str) -> bytes:
        with self.system.open_input_stream(f"{self.base}/{path}") as stream:
            return stream.read()


class SourceTree(DataSource):
    """Options: path (the root), patterns (JSON list of ignore patterns, in order), prefixes and extensions (JSON
    lists; paths begin or end with one of them), names (a regular expression that paths hold), contents
    ("false": null), spread (directories to open on the driver), changes ("true": the stream's columns).
    A root that is not there has no files."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return CHANGES if self.options.get("changes", "false") == "true" else SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options["path"])


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.patterns = options["path"], json.loads(options.get("patterns", "[]"))
        self.contents, self.spread = options.get("contents", "true") == "true", int(options.get("spread", SPREAD))
        self.prefixes, self.extensions = (tuple(json.loads(options.get(k, "[]"))) for k in ("prefixes", "extensions"))
        self.names = options.get("names")

    def keeps(self, told: dict[str, object]) -> bool:
        path = told["path"]
        return (
            (not self.prefixes or path.startswith(self.prefixes))
            and (not self.extensions or told["extension"] in self.extensions)
            and (self.names is None or re.search(self.names, path) is not None)
        )

    def enters(self, prefix: str) -> bool:
        """Whether a directory can hold a path that begins as asked."""
        inside = f"{prefix}/"
        return not self.prefixes or any(p.startswith(inside) or inside.startswith(p) for p in self.prefixes)

    def partitions(self) -> list[Directory]:
        from pyarrow import fs

        tree = _Tree(self.root, self.patterns)
        if tree.system.get_file_info(tree.base or "/").type != fs.FileType.Directory:
            return []
        shallow, deep = [], [""]
        while deep and len(deep) < self.spread:
            opened = [(p, tree.entries(p)[0]) for p in deep]
            below = [d for _, folders in opened for d in folders if self.enters(d)]
            if not below:
                break
            shallow += [p for p, _ in opened]
            deep = below
        return [*(Directory(p, False) for p in shallow), *(Directory(p, True) for p in deep)] or [Directory("", True)]

    def read(self, partition: Directory | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark reads where there is no partition
            return
        tree, todo = _Tree(self.root, self.patterns), [partition.prefix]
        rows, size = [], 0
        while todo:
            folders, files = tree.entries(todo.pop())
            if partition.deep:
                todo += [d for d in reversed(folders) if self.enters(d)]
            for path, n in files:
                told = facts(path)
                if not self.keeps(told):
                    continue
                content = tree.open(path) if self.contents else None
                rows.append({**told, "size_bytes": n, "content": content})
                size += len(content or b"") + 200
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _FIELDS)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _FIELDS)


@dataclass
class Changes(InputPartition):
    """Some of the paths that changed up to a commit, each with how."""

    commit: str
    paths: list[tuple[str, str]]


class ChangeReader(DataSourceStreamReader):
    """Files of a git working copy as they changed from commit to commit: added, modified, deleted. The first
    batch has all files of the commit that is then checked out. The driver only has the changed
    paths; tasks fetch the contents from the working copy, which all executors must see."""

    #: What a tree without files is called, whose difference to a commit is all its files. A fixed value of git's.
    NOTHING = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
    #: Paths of a task.
    PATHS = 500

    def __init__(self, root: str):
        self.root = re.sub("^file:/*", "/", root)

    def _git(self, *args: str) -> bytes:
        return subprocess.run(["git", "-C", self.root, *args], capture_output=True, check=True).stdout

    def initialOffset(self) -> dict:
        return {"commit": self.NOTHING}

    def latestOffset(self) -> dict:
        return {"commit": self._git("rev-parse", "HEAD").decode().strip()}

    def partitions(self, start: dict, end: dict) -> list[Changes]:
        told = self._git("diff", "--name-status", "--no-renames", "-z", start["commit"], end["commit"]).split(b"\0")
        paths = [(raw.decode(errors="replace"), {"A": "added", "D": "deleted"}.get(state.decode()[:1], "modified")) for state, raw in zip(told[::2], told[1::2])]
        return [Changes(end["commit"], paths[i : i + self.PATHS]) for i in range(0, len(paths), self.PATHS)]

    def read(self, partition: Changes | None) -> Iterator[tuple]:
        for path, change in partition.paths if partition else ():
            yield path, partition.commit, change, None if change == "deleted" else self._git("show", f"{partition.commit}:{path}")


def opens(root: str) -> bool:
    """Whether Arrow has the root's file system."""
    try:
        _Tree(root, [])
    except (pa.ArrowException, OSError, ImportError):
        return False
    return True


def is_folder(root: str) -> bool:
    from pyarrow import fs

    tree = _Tree(root, [])
    return tree.system.get_file_info(tree.base or "/").type == fs.FileType.Directory


def registered(spark: SparkSession) -> None:
    know_package(spark)
    spark.dataSource.register(SourceTree)


def files_below(spark: SparkSession, root: str, patterns: tuple[str, ...] = (), prefixes: tuple[str, ...] = (), extensions: tuple[str, ...] = (), names: str | None = None, contents: bool = True, spread: int = SPREAD) -> DataFrame:
    """The files below a root (columns of SCHEMA), none that the patterns ignore, whose paths are as asked."""
    registered(spark)
    told = spark.read.format("source_tree").option("contents", str(contents).lower()).option("spread", str(spread))
    for key, values in (("patterns", patterns), ("prefixes", prefixes), ("extensions", extensions)):
        told = told.option(key, json.dumps(list(values)))
    return (told if names is None else told.option("names", names)).load(root)


def changes_of(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the files that change in a git working copy (columns of CHANGES)."""
    registered(spark)
    return spark.readStream.format("source_tree").option("changes", "true").load(root)
