"""Queries over files. Their input is a small tree given here, as the tables hold no files."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.operators.codefacts import code_tables, summary
from corroba.plans.registry import query
from corroba.sources.files import described, ingest

SOURCES = {
    "src/shop/__init__.py": '"""A shop."""\nfrom .cart import *\n',
    "src/shop/cart.py": "import json\nfrom . import money\n\n\nclass Cart:\n    def add(self, item):\n        import time\n\n\ndef _total(cart, /, *items, tax, **more) -> int:\n    return 0\n",
    "src/shop/cli.py": "import typer\n\napp = typer.Typer()\n\n\nasync def serve(name, *, port) -> None:\n    pass\n\n\nif __name__ == '__main__':\n    app()\n",
    "src/shop/broken.py": "def (:\n",
    "tests/test_cart.py": "from shop.cart import Cart\n\n\ndef test_add():\n    assert Cart\n",
    "docs/note.txt": "not code",
}


def small_docx(*paragraphs: str) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def files_of(spark: SparkSession, contents: dict[str, str | bytes]) -> DataFrame:
    rows = [(p, bytearray(c.encode() if isinstance(c, str) else c)) for p, c in contents.items()]
    return described(spark.createDataFrame(rows, "path string, content binary"))


_FACTS = (
    ("module", "shop", "1"), ("module", "shop.cart", "10"), ("module", "shop.cli", "12"), ("module", "tests.test_cart", "2"),
    ("symbol", "shop.cart", "class Cart"), ("symbol", "shop.cart", "_total(cart, /, *items, tax, **more) -> int"), ("symbol", "shop.cli", "async serve(name, *, port) -> None"), ("symbol", "tests.test_cart", "test_add()"),
    ("import", "shop", ".cart.*"), ("import", "shop.cart", "json"), ("import", "shop.cart", ".money"), ("import", "shop.cart", "time"), ("import", "shop.cli", "typer"), ("import", "tests.test_cart", "shop.cart.Cart"),
    ("entrypoint", "shop.cli", "shop.cli:filename_hint"), ("entrypoint", "shop.cli", "shop.cli:typer_app:app"), ("entrypoint", "shop.cli", "shop.cli:__main__"), ("hint", "", "typer"),
    ("excerpt", "shop", "1-2"), ("excerpt", "shop.cart", "5-11"), ("excerpt", "shop.cli", "6-11"), ("excerpt", "tests.test_cart", "4-5"),
)


@query("SELECT fact, module_name, value FROM (VALUES " + ", ".join(map(str, _FACTS)) + ") AS f(fact, module_name, value)")
def code_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = code_tables(files_of(spark, SOURCES))
    parts = (
        found["modules"].select(F.lit("module").alias("fact"), "module_name", F.col("module_importance_score").cast("string").alias("value")),
        found["symbols"].select(F.lit("symbol"), "module_name", "signature"),
        found["imports"].select(F.lit("import"), "source_module", "imported_module"),
        found["entrypoints"].select(F.lit("entrypoint"), "module_name", "label"),
        found["framework_hints"].select(F.lit("hint"), F.lit(""), "hint"),
        found["excerpts"].select(F.lit("excerpt"), "module_name", F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string"))),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("SELECT modules, test_modules, symbols, classes, functions, imports, entrypoints, excerpts, hints FROM (VALUES (4, 1, 4, 1, 3, 6, 3, 4, 'typer')) AS f(modules, test_modules, symbols, classes, functions, imports, entrypoints, excerpts, hints)")
def code_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(code_tables(files_of(spark, SOURCES))).withColumn("hints", F.array_join("framework_hints", ",")).drop("framework_hints")


@query(
    """SELECT path, status, title, char_count FROM (VALUES ('a.md', 'parsed', 'Notes', 13), ('b.txt', 'parsed', 'first', 12), ('empty.txt', 'parsed', 'empty', 0), ('c.docx', 'parsed', 'Title', 11),
    ('bad.docx', 'unparsed', NULL, 0), ('bad.pdf', 'unparsed', NULL, 0)) AS f(path, status, title, char_count)"""
)
def binary_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = files_of(
        spark,
        {"a.md": "# Notes\n\ntext", "b.txt": "first\nsecond", "empty.txt": "", "c.docx": small_docx("Title", "Body"), "bad.docx": b"no zip", "bad.pdf": b"no pdf", "d.rst": "skipped"},
    )
    documents, unparsed = ingest(files)
    return documents.select("path", F.lit("parsed").alias("status"), "title", "char_count").union(
        unparsed.select("path", F.lit("unparsed"), F.lit(None).cast("string"), F.lit(0).cast("long"))
    )
