"""Rows to Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _joined(rows: list[Column] | Column, text: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x[text]), "\n")


def page(lines: DataFrame, title: str, order: str, line: str) -> DataFrame:
    """A page for each title: a heading and the lines in order."""
    body = _joined(F.struct(F.col(order).alias("o"), F.col(line).alias("t")), "t")
    return lines.groupBy(title).agg(F.concat(F.lit("# "), F.first(title), F.lit("\n\n"), body, F.lit("\n")).alias("page"))


def block_lines(blocks: Column) -> Column:
    """A section's blocks as text. Paragraphs have an empty line after them; numbered items count
    from 1 in their section; a section ends with an empty line."""

    def line(x: Column, i: Column) -> Column:
        number = F.size(F.filter(F.slice(blocks, F.lit(1), i + 1), lambda b: b["kind"] == "numbered_item"))
        return (
            F.when(x["kind"] == "bullet", F.concat(F.lit("- "), x["text"]))
            .when(x["kind"] == "labeled_bullet", F.concat(F.lit("- **"), x["label"], F.lit(":** "), x["text"]))
            .when(x["kind"] == "numbered_item", F.concat(number.cast("string"), F.lit(". "), x["text"]))
            .otherwise(F.concat(x["text"], F.lit("\n")))
        )

    return F.array_join(F.transform(blocks, line), "\n")


def section_page(sections: DataFrame, key: str, title: str, note: str, headings: tuple[str, ...]) -> DataFrame:
    """key, page: title, note and all headings in their order, with blocks (heading, blocks) or, where a
    heading has none, a notice. Rows of a key share title and note."""
    known = F.map_from_entries(F.collect_list(F.struct("heading", block_lines(F.col("blocks")).alias("text"))))
    pages = sections.groupBy(key).agg(F.first(title).alias("title"), F.first(note).alias("note"), known.alias("known"))
    parts = [F.concat(F.lit(f"## {h}\n\n"), F.coalesce(F.rtrim(F.col("known")[h], F.lit("\n")), F.lit("_Content unavailable after validation._"))) for h in headings]
    return pages.select(key, F.concat(F.lit("# "), "title", F.lit("\n\n"), "note", F.lit("\n\n"), F.concat_ws("\n\n", *parts), F.lit("\n")).alias("page"))


def diagnostics_block(told: DataFrame, most: int = 5) -> DataFrame:
    """One row, block: totals, counts by severity and stage (the larger first), and the `most`
    frequent patterns of diagnostics (code, severity, stage). Only counts are gathered."""
    counted = told.groupBy("code", "severity", "stage").agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "code", "stage", "severity").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "code", "stage", "severity"))  # of `most` rows
    line = F.concat(F.lit("- `"), "code", F.lit("` ("), "severity", F.lit("/"), "stage", F.lit("): "), F.col("n").cast("string"))
    patterns = top.withColumn("r", place).agg(_joined(F.struct("r", line.alias("t")), "t").alias("patterns"))

    def by(column: str) -> DataFrame:
        rows = counted.groupBy(column).agg(F.sum("n").alias("n"))
        row = F.struct((-F.col("n")).alias("low"), F.col(column), F.concat(column, F.lit("="), F.col("n").cast("string")).alias("t"))
        return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]), ", ").alias(column))

    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    one = total.join(by("severity")).join(by("stage")).join(patterns)  # one row each
    none = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("none"))
    return one.select(
        F.concat(
            F.lit("- Total diagnostics: "), F.col("total").cast("string"), F.lit("\n- Severity counts: "), none("severity"), F.lit("\n- Stage counts: "), none("stage"), F.lit("\n- Top diagnostic patterns:\n"),
            F.coalesce(F.nullif(F.col("patterns"), F.lit("")), F.lit("  - none")),
        ).alias("block")
    )


# What of the textual evidence a section shows: how many, and in what order.
EVIDENCE = {"overview": 4, "architecture": 6, "code_structure": 7, "runtime_entrypoints": 6, "": 6}
NOT_AUTHORITATIVE = ("readme", "runtime_config")


def authoritative(evidence: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """section, place, path: the evidence (category, path) that each section rests on; READMEs and runtime
    configuration are none. Sections without an order of their own go by category and path."""
    usable = evidence.filter(~F.col("category").isin(*NOT_AUTHORITATIVE))
    most = F.broadcast(usable.sparkSession.createDataFrame([(s, EVIDENCE.get(s, EVIDENCE[""])) for s in sections], "section string, most int"))
    section, category = F.col("section"), F.col("category")
    config_first = section.isin("overview", "code_structure") & (category != "package_config")
    tests_last = section.isin("architecture", "code_structure", "runtime_entrypoints") & (category == "test_file")
    by_category = F.when(~section.isin("overview", "code_structure"), category)
    # within a category all sections go by path: its first ones are enough, and what is sorted is not yet repeated for each section
    in_category = F.row_number().over(Window.partitionBy("category").orderBy("path"))
    usable = usable.withColumn("r", in_category).filter(F.col("r") <= max(EVIDENCE.values())).drop("r")
    offered = usable.join(most, F.lit(True))
    place = F.row_number().over(Window.partitionBy("section").orderBy(config_first, tests_last, by_category, "path"))
    found = offered.withColumn("place", place).filter(F.col("place") <= max(EVIDENCE.values()))
    return found.filter(F.col("place") <= F.col("most")).select("section", "place", "path")
