"""Trees of files as tables: scanning, decoding, ingesting documents."""

from __future__ import annotations

import io
import re
import subprocess
import tomllib
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.functions import text as T
from corroba.operators.ignore import IgnoreRules
from corroba.sources.tree import files_below, is_folder, opens  # noqa: F401

# Extensions that documents are ingested from, files that a manifest looks for,
# files that show what a tree is about, and how much of them is shown.
INGESTED = (".md", ".txt", ".pdf", ".docx")
ROOT_FILES = {"README.md": "readme", "pyproject.toml": "runtime_config", "mkdocs.yml": "runtime_config"}
ROOT_LINES, ROOT_CHARS, TEST_LINES, TEST_CHARS, TEST_FILES = 40, 2400, 24, 1600, 6

FILES = "path string, parent string, name string, depth int, extension string, size_bytes long, content binary"


def described(files: DataFrame) -> DataFrame:
    """path (relative), content -> the columns of FILES."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path",
        F.regexp_replace("path", "/?[^/]*$", "").alias("parent"),
        name.alias("name"),
        (F.size(F.split("path", "/")) - 1).alias("depth"),
        F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("extension"),
        F.length("content").cast("long").alias("size_bytes"),
        "content",
    )


def listed(spark: SparkSession, root: str, rules: IgnoreRules | None = None) -> list[str]:
    """Paths of the files below root, on any file system that Spark reads, relative to it. Ignored
    directories are not entered; names that Spark takes for hidden ones (`__init__.py`) are listed."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    top = fs_path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found, todo = [], [(top, "")]
    while todo:
        folder, prefix = todo.pop()
        for status in fs.listStatus(folder):
            name = prefix + status.getPath().getName()
            if rules and rules.is_ignored(name, status.isDirectory()):
                continue
            if status.isDirectory():
                todo.append((status.getPath(), f"{name}/"))
            else:
                found.append(name)
    return sorted(found)


def scan(spark: SparkSession, root: str, rules: IgnoreRules | None = None, names: str | None = None) -> DataFrame:
    """The files below root whose names match, with their contents; ignored ones are never read.
    Directories are listed in tasks; only on file systems that Arrow has not, by the driver."""
    if opens(root):
        return files_below(spark, root, rules.patterns if rules else (), names=names)
    base = root.rstrip("/")
    paths = [p for p in listed(spark, root, rules) if names is None or re.search(names, p)]
    if not paths:
        return described(spark.createDataFrame([], "path string, content binary"))
    # below the root, whatever scheme Spark writes paths with
    above = re.sub("^[a-z]+:/*", "/", base).rstrip("/") + "/"
    plain = F.concat(F.lit("\0"), F.regexp_replace("path", "^[a-z]+:/*", "/"))
    hidden = [p for p in paths if p.rsplit("/", 1)[-1][0] in "_."]
    shown = [p for p in paths if p not in set(hidden)]
    parts = []
    if shown:
        files = spark.read.format("binaryFile").load([f"{base}/{p}" for p in shown])
        parts.append(files.select(F.substring_index(plain, "\0" + above, -1).alias("path"), "content"))
    if hidden:  # which Spark's own reader passes by
        parts.append(spark.createDataFrame([(p,) for p in hidden], "path string").mapInArrow(lambda b: _read_each(b, base), "path string, content binary"))
    return described(parts[0] if len(parts) == 1 else parts[0].union(parts[1]))


def _read_each(batches: Iterable[pa.RecordBatch], base: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        contents = []
        for path in batch.column(0).to_pylist():
            system, place = fs.FileSystem.from_uri(f"{base}/{path}")
            with system.open_input_stream(place) as stream:
                contents.append(stream.read())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary())], names=["path", "content"])


def manifest(files: DataFrame) -> DataFrame:
    """One row: the top level's directories and files, and which known ones there are."""
    top = F.split("path", "/")[0]
    nested = F.col("depth") > 0
    names = files.agg(
        F.array_sort(F.collect_set(F.when(nested, top))).alias("top_level_directories"), F.array_sort(F.collect_set(F.when(~nested, top))).alias("top_level_files")
    )
    has = {"has_pyproject": "pyproject.toml", "has_mkdocs_config": "mkdocs.yml"}
    folders = {"has_git_dir": ".git", "has_docs_dir": "docs", "has_src_dir": "src", "has_tests_dir": "tests"}
    for column, name in has.items():
        names = names.withColumn(column, F.array_contains("top_level_files", name))
    for column, name in folders.items():
        names = names.withColumn(column, F.array_contains("top_level_directories", name))
    return names


def decoded(content: Column | str = "content") -> Column:
    """UTF-8 with replacement characters for what is not."""
    return F.make_valid_utf8(F.col(content).cast("string") if isinstance(content, str) else content.cast("string"))


def decoded_or_null(content: str = "content") -> Column:
    return F.try_validate_utf8(F.col(content).cast("string"))


def excerpt(text: Column, lines: int, chars: int) -> Column:
    """The first lines, cut to chars with `...` on a line of its own."""
    first = F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")
    return F.when(F.length(first) > chars, F.concat(F.rtrim(F.left(first, F.lit(chars)), F.lit(T.SPACES)), F.lit("\n..."))).otherwise(first)


def textual_evidence(files: DataFrame) -> DataFrame:
    """Excerpts of the known root files and of the first readable test files."""
    readable = files.withColumn("text", decoded_or_null()).filter("text IS NOT NULL")
    category = F.create_map(*(F.lit(x) for pair in ROOT_FILES.items() for x in pair))[F.col("name")]
    roots = readable.filter(F.col("path").isin(*ROOT_FILES)).select(category.alias("category"), "path", excerpt(F.col("text"), ROOT_LINES, ROOT_CHARS).alias("excerpt"))
    tests = readable.filter(F.col("name").startswith("test_") & (F.col("extension") == ".py") & F.col("path").startswith("tests/"))
    tests = tests.orderBy("path").limit(TEST_FILES).select(F.lit("test").alias("category"), "path", excerpt(F.col("text"), TEST_LINES, TEST_CHARS).alias("excerpt"))
    return roots.unionByName(tests)


def _docx(content: bytes) -> str:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{w}t")) for p in body.iter(f"{w}p"))
    return "\n\n".join(p for p in paragraphs if p.strip()).strip()


def _pdf(content: bytes) -> str:
    from pypdf import PdfReader  # not everywhere; without it PDFs stay unparsed

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages).strip()


def ingest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, unparsed): plain texts are decoded by Spark, the others by a parser in
    Arrow batches; what a parser fails on is unparsed."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for extension, content in zip(batch.column("extension").to_pylist(), batch.column("content").to_pylist()):
                try:
                    texts.append((_docx if extension == ".docx" else _pdf)(content))
                except Exception:  # noqa: BLE001  any damage makes the source unparsed
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("extension"), pa.array(texts, pa.string())], names=["path", "extension", "raw_text"])

    eligible = files.filter(F.col("extension").isin(*INGESTED)).select("path", "extension", "content")
    plain = eligible.filter(F.col("extension").isin(".md", ".txt")).select("path", "extension", decoded().alias("raw_text"))
    binary = eligible.filter(~F.col("extension").isin(".md", ".txt")).mapInArrow(parse, "path string, extension string, raw_text string")
    read = plain.unionByName(binary)
    documents = read.filter("raw_text IS NOT NULL").select(
        "path", "extension", title(F.col("raw_text"), F.col("path"), F.col("extension")).alias("title"), "raw_text", F.length("raw_text").cast("long").alias("char_count")
    )
    return documents, read.filter("raw_text IS NULL").select("path", "extension")


def title(text: Column, path: Column, extension: Column) -> Column:
    """Markdown: the first `# ` heading (an empty one gives the stem); else the first line with
    text; else the file's stem."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    lines = T.parts(text, "\n")
    heading = F.try_element_at(F.filter(lines, lambda x: x.startswith("# ") | (x == "#")), F.lit(1))
    of_heading = F.coalesce(F.nullif(T.strip(F.regexp_replace(heading, "^#", "")), F.lit("")), stem)
    return F.when((extension == ".md") & heading.isNotNull(), of_heading).otherwise(F.coalesce(F.try_element_at(lines, F.lit(1)), stem))


def markdown_blocks(documents: DataFrame) -> DataFrame:
    """path, block_index, text, section_hint. Markdown: blank lines and headings end blocks,
    headings are dropped but stay as the hint; other texts are cut at blank lines."""
    line = F.posexplode(F.split(F.regexp_replace("raw_text", "\r\n?", "\n"), "\n")).alias("n", "line")
    lines = documents.filter("extension = '.md'").select("path", line).withColumn("line", F.rtrim("line", F.lit(T.SPACES)))
    from pyspark.sql import Window

    order = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    is_heading, blank = F.ltrim("line").startswith("#"), T.strip("line") == ""
    heading = F.when(is_heading, F.nullif(T.strip(F.regexp_replace(F.ltrim("line"), "^#+", "")), F.lit("")))
    marked = lines.select("path", "n", "line", (is_heading | blank).alias("ends"), F.last(heading, ignorenulls=True).over(order).alias("section_hint"))
    islands = marked.withColumn("island", F.sum(F.col("ends").cast("int")).over(order)).filter("NOT ends")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    blocks = islands.groupBy("path", "island").agg(T.strip(text).alias("text"), F.first("section_hint").alias("section_hint"))
    number = (F.row_number().over(Window.partitionBy("path").orderBy("island")) - 1).cast("long")
    md = blocks.select("path", number.alias("block_index"), "text", "section_hint")
    plain = documents.filter("extension <> '.md'").select("path", F.posexplode(T.parts("raw_text", "\n\n")).alias("n", "text"))
    return md.unionByName(plain.select("path", F.col("n").cast("long").alias("block_index"), "text", F.lit(None).cast("string").alias("section_hint")))


def read_toml(path: str) -> dict:
    """A TOML file on the driver; a missing one is empty."""
    file = Path(path)
    return tomllib.loads(file.read_text("utf-8")) if file.is_file() else {}


def flattened(tree: dict, prefix: str = "") -> list[tuple[str, str]]:
    """Nested configuration as (dotted key, value) rows."""
    rows = []
    for key, value in tree.items():
        name = f"{prefix}{key}"
        rows += flattened(value, f"{name}.") if isinstance(value, dict) else [(name, ",".join(map(str, value)) if isinstance(value, list) else str(value))]
    return rows


def changed_files(root: str) -> list[str] | None:
    """Paths that differ from the last commit, and untracked ones, sorted; None where git can't tell."""

    def git(*args: str) -> list[str] | None:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False)
        return done.stdout.splitlines() if done.returncode == 0 else None

    tracked = git("diff", "--name-only", "HEAD")
    if tracked is None:
        staged, work = git("diff", "--name-only", "--cached"), git("diff", "--name-only")
        tracked = None if staged is None or work is None else staged + work
    fresh = git("ls-files", "--others", "--exclude-standard")
    return None if tracked is None or fresh is None else sorted({*tracked, *fresh})
