"""Change plans and retry schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def under(path: Column, prefix: str) -> Column:
    """Whether a path is the prefix or lies below it; an empty prefix holds nothing. A prefix from the
    file system's root holds whole paths, too, beside those that begin at the tree's root."""
    whole = prefix.replace("\\", "/").rstrip("/")
    out = F.lit(False)
    for clean in {whole.strip("/"), whole} - {""}:
        out = out | (path == clean) | path.startswith(clean + "/")
    return out


def under_any(path: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | under(path, p)
    return out


# Files that configure the build.
CONFIG_FILES = ("mkdocs.yml", "corroba.toml", "pyproject.toml", ".env", ".env.example")


def change_plan(changed: DataFrame, keys: list[str], source: tuple[str, ...], reference: tuple[str, ...], docs: tuple[str, ...], config: Column) -> DataFrame:
    """What kind of files changed (column path), by keys, and the reason to rebuild."""
    path = F.col("path")
    flags_of = {"source_changed": under_any(path, source), "reference_changed": under_any(path, reference), "docs_or_config_changed": (under_any(path, docs) & ~under_any(path, reference)) | config}
    flags = changed.groupBy(*keys).agg(
        *(F.coalesce(F.bool_or(holds), F.lit(False)).alias(name) for name, holds in flags_of.items()),
        F.count("*").alias("n_changed"),
    )
    reason = (
        F.when(F.col("n_changed") == 0, "nothing changed")
        .when(F.col("docs_or_config_changed"), "documentation or configuration changed")
        .when(F.col("source_changed") & F.col("reference_changed"), "source and reference changed")
        .when(F.col("source_changed"), "source changed")
        .when(F.col("reference_changed"), "reference changed")
        .otherwise("unrelated changes")
    )
    return flags.withColumn("reason", reason)


def timeout_ladder(first: int, cap: int) -> Column:
    """first, twice that, and so on, ending with the cap."""
    steps = 0
    while first << steps < cap:
        steps += 1
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.least(F.lit(first) * F.pow(F.lit(2), i), F.lit(cap)).cast("long"))


def place_of_reference(path: Column, root: str, is_dir: Column) -> Column:
    """Whether a reference lies outside the root, or is a directory or a file in it."""
    return F.when((path != root.rstrip("/")) & ~path.startswith(root.rstrip("/") + "/"), "outside").when(is_dir, "directory").otherwise("file")


def plan_text(plan: DataFrame) -> DataFrame:
    """All columns of a plan with text: its lines for people to read."""
    flags = [F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in ("source_changed", "reference_changed", "docs_or_config_changed")]
    head = F.concat(F.lit("changed files: "), F.col("n_changed").cast("string"))
    return plan.withColumn("text", F.concat_ws("\n", F.lit("Update plan"), head, *flags, F.lit("full regeneration: true"), F.concat(F.lit("reason: "), F.col("reason"))))
