"""Paths as data: normal forms, and joins with tables of roots that lie above them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolved(path: Column | str, base: str = "/") -> Column:
    """The absolute path without `.`, `..` and doubled slashes; relative ones begin at base. What would
    lie above the file system's root is the root. Links are not followed."""
    path = F.col(path) if isinstance(path, str) else path
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))

    def step(held: Column, x: Column) -> Column:
        up = F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))
        return F.when(x.isin("", "."), held).when(x == "..", up).otherwise(F.concat(held, F.array(x)))

    steps = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(steps, "/"))


def cuts(path: Column | str, separator: str = "/") -> Column:
    """The path and all its beginnings that end before a separator: of /a/b these are /a and /a/b."""
    steps = F.split(F.col(path) if isinstance(path, str) else path, f"[{separator}]")
    every = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), separator))
    return F.filter(every, lambda x: x != "")


def under_roots(rows: DataFrame, path: str, roots: DataFrame, root: str, separator: str = "/") -> DataFrame:
    """rows joined with each root that their path is or lies below (separator "#": of whose text it is a
    part), on the path's own beginnings: a hash join of as many rows as paths have steps, whatever
    the number of roots. Null and empty paths and roots match nothing; a root's final separators don't
    count."""
    clean = roots.withColumn("_at", F.rtrim(root, F.lit(separator)))
    return rows.withColumn("_at", F.explode(cuts(path, separator))).join(clean, "_at").drop("_at")


def nearest_root(rows: DataFrame, key: str, path: str, roots: DataFrame, root: str) -> DataFrame:
    """key, root: the deepest root above each row's path; rows without one are left out."""
    known = roots.select(F.rtrim(root, F.lit("/")).alias("_root")).distinct()
    found = under_roots(rows.select(key, F.col(path).alias("_path")), "_path", known, "_root")
    return found.groupBy(key).agg(F.max_by("_root", F.length("_root")).alias(root))
