"""Pages as a data sink: df.write.format("pages").save(folder), for rows of path and page.

Tasks write pages into a staging folder beside their places; the commit moves them there one by one,
writes the index and removes pages of earlier runs that are no more. An aborted or failed job
leaves everything as it was. Pages that were written by hand, which have none of the marks of
managed ones, are neither overwritten nor removed.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from corroba.functions.values import MANAGED
from corroba.operators.workers import know_package

#: What the sink keeps of its last commit, and the index that it writes.
LEDGER, INDEX = ".pages.json", "README.md"


@dataclass
class Written(WriterCommitMessage):
    """What one task has staged: (path, title) of its pages, and the paths that it left to their authors."""

    pages: list[tuple[str, str]]
    authored: list[str]


def place_below(path: str) -> str:
    """A page's path, which must lie below the folder."""
    steps = [s for s in path.split("/") if s not in ("", ".")]
    if not steps or ".." in steps or steps[0].startswith(".pages"):
        raise ValueError(f"no page below the folder: {path!r}")
    return "/".join(steps)


class PageSink(DataSource):
    """Options: path (the folder), index ("true": a page that lists the others), title (of the index), marks (JSON
    list: what tells managed pages). mode("overwrite") removes managed pages of the last commit that
    are no more; mode("append") removes none. Of pages of one path any may stay."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "path string, page string"

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options, overwrite)


class PageWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        from pyarrow import fs

        root = options["path"]
        self.system, self.root = fs.FileSystem.from_uri(root) if re.match("[a-z0-9]+:", root) else (fs.LocalFileSystem(), root)
        self.root = self.root.rstrip("/")
        self.staging = f"{self.root}/.pages-{uuid.uuid4().hex}"
        self.overwrite, self.index = overwrite, options.get("index", "false") == "true"
        self.title, self.marks = options.get("title", "Pages"), json.loads(options.get("marks", json.dumps(MANAGED)))

    def _read(self, place: str) -> str | None:
        from pyarrow import fs

        if self.system.get_file_info(place).type != fs.FileType.File:
            return None
        with self.system.open_input_stream(place) as stream:
            return stream.read().decode(errors="replace")

    def _write(self, place: str, text: str) -> None:
        self.system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with self.system.open_output_stream(place) as stream:
            stream.write(text.encode())

    def _authored(self, place: str) -> bool:
        old = self._read(place)
        return bool(old and old.strip()) and not any(m in old for m in self.marks)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        pages, authored = [], []
        for batch in iterator:
            for path, page in zip(batch.column("path").to_pylist(), batch.column("page").to_pylist()):
                place, text = place_below(path or ""), page or ""
                if self._authored(f"{self.root}/{place}"):
                    authored.append(place)
                    continue
                self._write(f"{self.staging}/{place}", text)
                heading = re.match(r"\s*#[ \t]+([^\n]+)", text)
                pages.append((place, heading[1].strip() if heading else place.rsplit("/", 1)[-1].removesuffix(".md")))
        return Written(sorted(pages), authored)

    def commit(self, messages: list[Written | None]) -> None:
        written = dict(p for m in messages if m is not None for p in m.pages)
        before = json.loads(self._read(f"{self.root}/{LEDGER}") or "{}")
        for path in sorted(written):
            self.system.create_dir(f"{self.root}/{path}".rsplit("/", 1)[0], recursive=True)
            self.system.move(f"{self.staging}/{path}", f"{self.root}/{path}")
        kept = dict(written) if self.overwrite else before | written
        if self.overwrite:
            for path in sorted(set(before) - set(written)):
                if self._read(f"{self.root}/{path}") is not None and not self._authored(f"{self.root}/{path}"):
                    self.system.delete_file(f"{self.root}/{path}")
        if self.index and INDEX not in written and not self._authored(f"{self.root}/{INDEX}"):
            lines = [f"# {self.title}", "", f"<!-- {self.marks[0]} -->", "", *(f"- [{title}]({path})" for path, title in sorted(kept.items()) if path.endswith(".md") and path != INDEX)]
            self._write(f"{self.staging}/{INDEX}", "\n".join(lines) + "\n")
            self.system.move(f"{self.staging}/{INDEX}", f"{self.root}/{INDEX}")
        self._write(f"{self.staging}/{LEDGER}", json.dumps(kept, indent=1, sort_keys=True, ensure_ascii=False))
        self.system.move(f"{self.staging}/{LEDGER}", f"{self.root}/{LEDGER}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        if self.system.get_file_info(self.staging).type == fs.FileType.Directory:
            self.system.delete_dir(self.staging)


def save_pages(pages: DataFrame, root: str, overwrite: bool = True, index: bool = True, title: str = "Pages") -> None:
    """Writes pages (path, page) below a folder that the driver and all executors share, all or none."""
    spark = pages.sparkSession
    know_package(spark)
    spark.dataSource.register(PageSink)
    rows = pages.select(pages["path"].cast("string").alias("path"), pages["page"].cast("string").alias("page"))
    rows.write.format("pages").mode("overwrite" if overwrite else "append").option("index", str(index).lower()).option("title", title).save(root)
