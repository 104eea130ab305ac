"""Matching atoms against evidence, and verdicts of claims from their atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a hit or its absence says, by matcher and polarity: (matcher, hit,
# polarity, result, tier). A closed world knows all that exists; an open one does not.
RULES = tuple(
    (matcher, hit, polarity, result, tier)
    for matcher, rows in {
        "exists_closed": (("supported", "exact"), ("contradicted", "exact"), ("contradicted", "structured_primary"), ("supported", "structured_primary")),
        "exists_open": (("supported", "exact"), ("contradicted", "exact"), ("unresolved", "structured_primary"), ("supported", "structured_primary")),
        "enum_contains": (("supported", "structured_primary"), ("contradicted", "structured_primary"), ("contradicted", "structured_primary"), ("unresolved", "heuristic_fallback")),
        "alias_maps": (("supported", "structured_primary"), ("contradicted", "structured_primary"), ("contradicted", "structured_primary"), ("supported", "structured_primary")),
        "policy_independent": (("supported", "structured_primary"), ("contradicted", "structured_primary"), ("unresolved", "structured_primary"), ("supported", "structured_primary")),
        "alias_first_path": (("supported", "structured_primary"), ("contradicted", "structured_primary"), ("unresolved", "structured_primary"), ("supported", "structured_primary")),
        "lexical": (("unresolved", "lexical_secondary"), ("unresolved", "lexical_secondary"), ("unresolved", "heuristic_fallback"), ("unresolved", "heuristic_fallback")),
    }.items()
    for (hit, polarity), (result, tier) in zip(((True, "positive"), (True, "negative"), (False, "positive"), (False, "negative")), rows)
)


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "matcher string, hit boolean, polarity string, result string, tier string")


def judge(atoms: DataFrame) -> DataFrame:
    """atoms with matcher, hit and polarity -> the same with result and tier. The rule table has 28 rows."""
    return atoms.join(F.broadcast(rule_table(atoms.sparkSession)), ["matcher", "hit", "polarity"])


def verdict(route: Column, verifiable: Column, contradicted: Column, supported: Column, unresolved: Column) -> Column:
    """The verdict of a claim from what its atoms came to."""
    return (
        F.when((route == "agent") & ~verifiable, "out_of_scope_or_non_verifiable")
        .when((route == "readme") & ~verifiable, "not_statically_verifiable")
        .when(contradicted, "contradicted")
        .when(supported & ~unresolved, "supported")
        .when(supported & unresolved, "partially_supported")
        .when(route == "general", "missing_evidence")
        .otherwise("not_evidenced")
    )


def first_by(rows: DataFrame, keys: list[str], order: Column, values: list[str], last: bool = False) -> DataFrame:
    """The values of the first (or last) row of each group: one partial aggregate, no sort."""
    pick = F.max_by if last else F.min_by
    return rows.groupBy(*keys).agg(pick(F.struct(*values), order).alias("picked")).select(*keys, "picked.*")
