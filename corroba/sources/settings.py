"""Settings, packages and the environment as rows. All are small and read on the driver."""

from __future__ import annotations

import os
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read_yaml(path: str) -> dict:
    """A YAML mapping; an empty file is an empty one, anything else than a mapping an error."""
    import yaml  # not everywhere

    found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def environment(spark: SparkSession, fields: dict[str, tuple[str, ...]], given: dict[str, str] | None = None) -> DataFrame:
    """field, variable, value: of each field's variables the first that is set."""
    values = os.environ if given is None else given
    rows = [next(((f, n, values[n]) for n in names if values.get(n) not in (None, "")), None) for f, names in fields.items()]
    return spark.createDataFrame([r for r in rows if r], "field string, variable string, value string")


def installed_packages(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """name, version, license_expression, license_field, classifiers, requires of packages: of the named
    ones (version is null where one is not installed), or of all that are installed."""
    found = {}
    for d in metadata.distributions():
        licences = [c for c in d.metadata.get_all("Classifier") or [] if c.startswith("License ::")]
        name = (d.metadata["Name"] or "").lower().replace("_", "-")
        found.setdefault(name, (name, d.version, d.metadata.get("License-Expression"), d.metadata.get("License"), licences, list(d.requires or [])))
    rows = list(found.values()) if names is None else [found.get(n, (n, None, None, None, None, None)) for n in names]
    return spark.createDataFrame(rows, "name string, version string, license_expression string, license_field string, classifiers array<string>, requires array<string>")


def commands(spark: SparkSession, names: list[str]) -> DataFrame:
    """command: the distinct registered names."""
    return spark.createDataFrame([(n,) for n in sorted({n for n in names if n})], "command string")
