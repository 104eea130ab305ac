"""Dependency and source inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroba.operators.graph import closure


def quality_class(signals: dict[str, Column]) -> Column:
    """missing without a signal, multiple with several, else the one's name."""
    count = sum((s.cast("int") for s in signals.values()), F.lit(0))
    out = F.when(count == 0, "missing").when(count > 1, "multiple")
    for name, holds in signals.items():
        out = out.when(holds, name)
    return out


def parse_state(eligible: Column, parsed: Column) -> Column:
    """parsed: true, false (tried in vain) or null (not tried)."""
    return F.when(~eligible, "not_ingestible").when(parsed, "parsed").when(~parsed, "ingestible_unparsed").otherwise("not_attempted")


def requirement_name(requirement: Column) -> Column:
    """The normal name of a requirement: before any marker, lower case, with dashes."""
    name = F.regexp_extract(F.split_part(requirement, F.lit(";"), F.lit(1)), r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    return F.replace(F.lower(name), F.lit("_"), F.lit("-"))


def license_summary(expression: Column, field: Column, classifiers: Column, quality: Column) -> Column:
    """What a package tells of its licence: its quality and each signal that it has; null and empty ones are none."""
    told = (
        F.when(expression != "", F.concat(F.lit("expr="), expression)),
        F.when(field != "", F.concat(F.lit("license="), field)),
        F.when(F.size(classifiers) > 0, F.concat(F.lit("classifiers="), F.array_join(classifiers, "; "))),
    )
    parts = F.array_compact(F.array(*told))
    return F.when(F.size(parts) == 0, "missing").otherwise(F.concat(quality, F.lit(": "), F.array_join(parts, " | ")))


def transitive(direct: DataFrame, installed: DataFrame, requires: DataFrame) -> DataFrame:
    """name, parents (sorted, comma-joined) of packages that installed direct ones (name) need,
    directly or not, and that are no direct ones themselves. Only installed packages tell what they
    require (name, needs)."""
    known = installed.select("name").distinct()
    edges = requires.join(known, "name", "left_semi").select(F.col("name").alias("parent"), F.col("needs").alias("child"))
    roots = direct.select("name").distinct().join(known, "name", "left_semi").withColumnRenamed("name", "node")
    found = closure(edges, roots).select(F.col("node").alias("name"), F.array_join(F.array_sort("parents"), ",").alias("parents"))
    return found.join(direct.select("name").distinct(), "name", "left_anti")


def failures(rows: DataFrame, name: str = "name") -> DataFrame:
    """condition, packages (sorted, comma-joined) for each condition that some rows meet. Rows: name, direct,
    installed, quality. Only direct packages must be installed."""
    met = F.array_compact(
        F.array(
            F.when(F.col("direct") & ~F.col("installed"), "not-installed"), F.when(F.col("quality") == "missing", "missing-license"), F.when(F.col("quality") == "classifier_only", "classifier-only")
        )
    )
    found = rows.select(F.explode(met).alias("condition"), F.col(name).alias("package"))
    return found.groupBy("condition").agg(F.array_join(F.array_sort(F.collect_list("package")), ", ").alias("packages"))


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A CSV line a row; arrays are joined by semicolons."""
    kinds = dict(rows.dtypes)
    values = [(F.array_join(c, ";") if kinds[c].startswith("array") else F.col(c).cast("string")).alias(c) for c in columns]
    return rows.select("*", F.to_csv(F.struct(*values)).alias("line"))


def declared(project: dict) -> list[tuple[str, str]]:
    """(source, requirement) of a pyproject table: runtime, each dev group, build system."""
    own = project.get("project", {})
    rows = [("runtime", r) for r in own.get("dependencies", [])]
    for group, requirements in [*own.get("optional-dependencies", {}).items(), *project.get("dependency-groups", {}).items()]:
        rows += [(f"dev:{group}", r) for r in requirements if isinstance(r, str)]
    return rows + [("build-system", r) for r in project.get("build-system", {}).get("requires", [])]


def dependencies(direct: DataFrame, installed: DataFrame) -> DataFrame:
    """name, source, requirement, direct, parents, installed, version, quality, summary: the direct packages (source,
    requirement), each once a source and requirement, and those that they need.

    installed: name, version, license_expression, license_field, classifiers, requires."""
    named = direct.select(requirement_name(F.col("requirement")).alias("name"), "source", "requirement").filter("name <> ''").distinct()
    needs = installed.select("name", F.explode("requires").alias("r")).select("name", requirement_name(F.col("r")).alias("needs")).filter("needs <> ''")
    more = transitive(named, installed, needs)
    rows = named.select("name", "source", "requirement", F.lit(True).alias("direct"), F.lit("").alias("parents")).union(
        more.select("name", F.lit("transitive"), F.lit(""), F.lit(False), "parents")
    )
    found = rows.join(installed.drop("requires"), "name", "left")
    expression, field = (F.btrim(F.coalesce(c, F.lit(""))) for c in ("license_expression", "license_field"))
    classifiers = F.coalesce("classifiers", F.array().cast("array<string>"))
    quality = quality_class({"license_expression": expression != "", "license_field_only": field != "", "classifier_only": F.size(classifiers) > 0})
    quality = F.when(quality == "multiple", "multiple_signals").otherwise(quality)
    told = found.withColumn("quality", quality).withColumn("summary", license_summary(expression, field, classifiers, F.col("quality")))
    return told.select("name", "source", "requirement", "direct", "parents", F.col("version").isNotNull().alias("installed"), "version", "quality", "summary")
