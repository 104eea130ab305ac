"""Claims: segmentation of prose, classification, atoms with what the fragment before told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroba.functions.text import contains_any, parts, strip

#: The command whose use claims speak of.
TOOL = "corroba"

# Claims about how a program behaves when it runs.
RUNTIME = (
    "fast", "low-latency", "latency", "performant", "performance", "production-ready", "easy to use", "reliable ux", "real-time",
    "high quality", "under 50ms", "50ms", "responds in", "network behavior",
)

# Words of a normal text -> type, whether it can be verified, scope. The first
# rule of a route with a word in the text holds; a rule without words holds for the rest.
CLASSES: dict[str, tuple[tuple, ...]] = {
    "agent": (
        (("be concise", "be polite", "friendly tone", "tone", "high quality", "think step by step"), "non_verifiable_guidance", "no", "style"),
        (("before release", f"run {TOOL}", "workflow"), "workflow_instruction", "yes", "workflow"),
        (("config",), "config_instruction", "yes", "config"),
        (("ignore",), "policy_instruction", "yes", "policy"),
        (("output", "generated"), "output_instruction", "yes", "output"),
        ((), "feature_instruction", "yes", "feature"),
    ),
    "readme": (
        (RUNTIME, "runtime_behavior", "no", "unknown"),
        (("quality", "easy", "reliable", "experience"), "quality_claim", "no", "unknown"),
        ((TOOL,), "cli_usage_static", "yes", "unknown"),
        (("generated", ".md"), "generated_output_static", "yes", "unknown"),
        (("config", "env"), "config_static", "yes", "unknown"),
        ((), "capability_static", "yes", "unknown"),
    ),
    "general": (
        (("route", "alignment"), "routing_requirement", "yes", "unknown"),
        (("compatibility", "alias", "preserve", "backward"), "compatibility_requirement", "yes", "unknown"),
        (("ignore", "gitignore"), "ignore_policy_requirement", "yes", "unknown"),
        (("config", "env", "setting"), "config_requirement", "yes", "unknown"),
        (("generated", "output", "page"), "output_requirement", "yes", "unknown"),
        ((), "feature_requirement", "yes", "unknown"),
    ),
}


def segment_line(line: Column) -> Column:
    """A line without one list mark and one number mark."""
    return F.regexp_replace(F.regexp_replace(line, r"^[-*][ \t]+", ""), r"^[0-9]+[.)][ \t]+", "")


def segments(rows: DataFrame, text: str = "text", opening: str = "Document") -> DataFrame:
    """All columns of rows but the text, with ordinal, section and line: the stripped lines of
    a text that are neither empty nor headings, counted from 0, each with the heading before
    it. Only texts with a heading are sorted by line; rows must tell texts apart."""
    keys = [c for c in rows.columns if c != text]
    headed = F.contains(text, F.lit("#")) & F.exists(parts(text, "\n"), lambda x: x.startswith("#"))
    lines = F.posexplode_outer(parts(text, "\n"))  # the inner form would split texts twice, to leave out empty ones first
    plain = rows.filter(~headed).select(*keys, lines.alias("ordinal", "line")).filter("line IS NOT NULL").withColumn("section", F.lit(opening))
    line = rows.filter(headed).select(*keys, lines.alias("at", "line"))
    so_far = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("line").startswith("#")
    heading = F.when(is_heading, F.nullif(strip(F.ltrim("line", F.lit("#"))), F.lit("")))
    carried = line.withColumn("section", F.coalesce(F.last(heading, ignorenulls=True).over(so_far), F.lit(opening))).withColumn(
        "ordinal", (F.count_if(~is_heading).over(so_far) - 1).cast("int")
    )
    columns = [*keys, "ordinal", "section", "line"]
    return plain.select(*columns).union(carried.filter(~is_heading).select(*columns))


def classify(route: Column, normal: Column) -> Column:
    """struct<claim_type, verifiable, scope>."""

    def value(kind: str, verifiable: str, scope: str) -> Column:
        return F.struct(F.lit(kind).alias("claim_type"), F.lit(verifiable == "yes").alias("verifiable"), F.lit(scope).alias("scope"))

    out = None
    for name, rules in CLASSES.items():
        of_route = value(*rules[-1][1:])
        for words, *values in reversed(rules[:-1]):
            of_route = F.when(contains_any(normal, words), value(*values)).otherwise(of_route)
        out = F.when(route == name, of_route) if out is None else out.when(route == name, of_route)
    return out


def fold_predicates(fragments: DataFrame, key: str, order: str, normal: str, rules: tuple[tuple[Column, str], ...], follows: Column) -> DataFrame:
    """key, order, predicate: the first rule's whose word a fragment holds; a fragment without
    one that holds `follows` takes the predicate of the fragment before, if that had a rule's."""
    names = [n for _, n in rules]

    def told(state: Column, fragment: Column) -> Column:
        before = F.try_element_at(state, F.lit(-1))["predicate"]
        out = F.when(F.coalesce(before.isin(*names), F.lit(False)) & F.contains(fragment["n"], follows), before).otherwise("lexical_hint")
        for word, name in reversed(rules):
            out = F.when(F.contains(fragment["n"], word), name).otherwise(out)
        return F.concat(state, F.array(F.struct(fragment["at"].alias("at"), out.alias("predicate"))))

    kind = dict(fragments.dtypes)[order]
    gathered = fragments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(normal).alias("n")))).alias("f"))
    folded = gathered.select(key, F.aggregate("f", F.array().cast(f"array<struct<at:{kind},predicate:string>>"), told).alias("out"))
    return folded.select(key, F.inline("out").alias(order, "predicate"))
