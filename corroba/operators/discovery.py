"""Reference materials: which files of a tree are held against the code, of what kind, by which route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroba.operators.ignore import to_regex
from corroba.operators.planning import under_any

# Files that instruct agents, and extensions that can be read as documents.
INSTRUCTIONS = ("AGENTS.md", "CLAUDE.md", "CODEX.md", "CURSOR.md", "AIDER.md", "CONTINUE.md", "GEMINI.md")
INGESTIBLE = (".md", ".txt", ".pdf", ".docx")
READMES = ("README.md",)
KINDS = {"readme": ("readme_claims", "readme_claim_alignment"), "agent": ("agent_instruction", "agent_instruction_alignment"), "general": ("general_reference", "general_reference_alignment")}


def globbed(path: Column, pattern: str) -> Column:
    """Whether a relative path matches a glob from the root; `**/` stands for any directories."""
    return path.rlike(to_regex("/" + pattern.lstrip("/")).replace("(?:/.*)?$", "$"))


def display_path(path: Column, root: str) -> Column:
    """The path relative to the root; as it is, if it lies elsewhere."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def discover(files: DataFrame, explicit: tuple[str, ...], readmes: tuple[str, ...] | None = READMES, instructions: tuple[str, ...] | None = tuple(f"**/{n}" for n in INSTRUCTIONS)) -> DataFrame:
    """path, extension, origin, kind, route, reason, eligible of the reference materials among files
    (path, relative to the root): those that are or lie under an explicit path, whatever their kind by
    name; then, where their patterns are not None, README files and agent instructions. A file goes
    by the first that finds it: explicit before default, then by the order of patterns."""
    path = F.col("path")
    name = F.upper(F.substring_index("path", "/", -1))
    which = F.when(name == "README.MD", "readme").when(name.isin(*map(str.upper, INSTRUCTIONS)), "agent").otherwise("general")
    tries = [F.when(under_any(path, explicit), F.struct(F.lit("explicit").alias("origin"), which.alias("which"), F.lit("explicit input").alias("reason")))]
    for kind, patterns, what in (("readme", readmes, "README"), ("agent", instructions, "agent instruction")):
        for pattern in patterns or ():
            tries.append(F.when(globbed(path, pattern), F.struct(F.lit("default").alias("origin"), F.lit(kind).alias("which"), F.lit(f"default {what} target (pattern={pattern})").alias("reason"))))
    found = files.select("path", F.coalesce(*tries).alias("f")).filter("f IS NOT NULL")
    kinds = F.create_map(*(F.lit(x) for k, (kind, _) in KINDS.items() for x in (k, kind)))
    routes = F.create_map(*(F.lit(x) for k, (_, route) in KINDS.items() for x in (k, route)))
    extension = F.lower(F.regexp_extract("path", r"[^/.][^/]*(\.[^./]+)$", 1))
    return found.select("path", extension.alias("extension"), "f.origin", kinds[F.col("f.which")].alias("kind"), routes[F.col("f.which")].alias("route"), "f.reason", extension.isin(*INGESTIBLE).alias("eligible"))


def ordered(found: DataFrame) -> DataFrame:
    """The inventory's order: default before explicit, then by kind and path."""
    return found.orderBy("origin", "kind", "path")


def grounding(found: DataFrame) -> DataFrame:
    """Materials that ground the general route: eligible ones on it."""
    return found.filter(F.col("eligible") & (F.col("route") == KINDS["general"][1]))


def with_status(found: DataFrame, parsed: DataFrame, unparsed: DataFrame) -> DataFrame:
    """found with parse_status, from the paths that were parsed and those that could not be."""
    tried = parsed.select("path", F.lit(True).alias("ok")).union(unparsed.select("path", F.lit(False))).groupBy("path").agg(F.bool_or("ok").alias("ok"))
    expected = F.col("route") == KINDS["general"][1]
    state = F.when(~F.col("eligible"), "not_ingestible").when(F.col("ok"), "parsed").when(F.col("ok").isNotNull() | expected, "ingestible_unparsed").otherwise("not_attempted")
    return found.join(tried, "path", "left").withColumn("parse_status", state).drop("ok")
