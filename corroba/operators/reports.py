"""Reports over rows: caps by route, checks, run summaries, navigation, and pages as files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroba.functions.values import managed
from corroba.operators.graph import set_checkpoints

#: Items that a route shows of its claims, and of the material it rests on.
SHOWN, MATERIAL = 10, 12


def capped(rows: DataFrame, route: str, order: list[str], most: int = SHOWN) -> DataFrame:
    """The first `most` rows of each route, with place."""
    place = F.row_number().over(Window.partitionBy(route).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def chunk_material(chunks: DataFrame, key: str, order: str, text: str, most: int, chars: int) -> DataFrame:
    """key, material: the first `most` chunks of a key, each cut to `chars`, an empty line between."""
    first = capped(chunks, key, [order], most)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", F.left(text, F.lit(chars)).alias("t")))), lambda x: x["t"])
    return first.groupBy(key).agg(F.array_join(parts, "\n\n").alias("material"))


def checks(rows: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """All columns of rows with check and level: by name, what passes and what only warns; the rest fails."""
    told = [F.struct(F.lit(n).alias("check"), F.when(F.coalesce(ok, F.lit(False)), "pass").when(F.coalesce(warns, F.lit(False)), "warn").otherwise("fail").alias("level")) for n, (ok, warns) in rules.items()]
    return rows.select("*", F.inline(F.array(*told)))


def to_write(pages: DataFrame, existing: DataFrame) -> DataFrame:
    """pages (path, page) that may be written: those that are not there, empty or marked as managed."""
    held = existing.select("path", F.col("page").alias("old"), F.lit(True).alias("there"))
    return pages.join(held, "path", "left").filter(F.col("there").isNull() | managed(F.col("old"))).drop("old", "there")


def write_pages(pages: DataFrame, root: str) -> DataFrame:
    """Write pages (path, page) as files below a folder that all executors share; path, bytes of
    each. A page lies in memory alone, and a task that is tried again writes the same."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            sizes = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, place = fs.FileSystem.from_uri(f"{root.rstrip('/')}/{path}")
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(place) as stream:
                    stream.write((text or "").encode())
                sizes.append(len((text or "").encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return pages.select("path", "page").mapInArrow(run, "path string, bytes long")


def navigation(trees: DataFrame, key: str, nav: str, deepest: int = 20) -> DataFrame:
    """key, place, label, target of the Markdown pages that a navigation (VARIANT) names: texts, objects of
    label and text or list, and lists, at any depth. The first mention of a target stays; place
    is the order of mention. Each round opens one level of lists and objects."""
    set_checkpoints(trees)
    level = trees.select(key, F.array().cast("array<int>").alias("way"), F.lit(None).cast("string").alias("label"), F.col(nav).alias("v"))
    found = None
    kind = F.schema_of_variant("v")
    for _ in range(deepest):
        texts = level.filter(kind == "STRING").select(key, "way", "label", F.try_variant_get("v", "$", "string").alias("target"))
        found = texts if found is None else found.union(texts)
        in_lists = level.filter(kind.startswith("ARRAY<")).select(key, "way", "label", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("at", "v"))
        in_objects = level.filter(kind.startswith("OBJECT<")).select(key, "way", F.posexplode(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))).alias("at", "e"))
        in_objects = in_objects.select(key, "way", F.col("e.key").alias("label"), "at", F.col("e.value").alias("v"))
        opened = in_lists.select(key, F.concat("way", F.array("at")).alias("way"), F.lit(None).cast("string").alias("label"), "v")
        level = opened.union(in_objects.select(key, F.concat("way", F.array("at")).alias("way"), "label", "v")).checkpoint()
        if level.isEmpty():
            break
    else:
        raise RuntimeError("navigation deeper than deepest")
    pages = found.filter(F.lower("target").endswith(".md"))
    first = pages.groupBy(key, "target").agg(F.min(F.struct("way", "label")).alias("f")).select(key, "target", "f.way", "f.label")
    place = F.row_number().over(Window.partitionBy(key).orderBy("way")) - 1
    return first.select(key, place.alias("place"), "label", "target")
