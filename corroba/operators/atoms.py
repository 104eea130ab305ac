"""Atoms of claims, the evidence that they are held against, and what comes of it.

A claim's fragments become atoms by the first of 20 rules that fires. Sixteen rules look at the
fragment alone; their first one is told by expressions over its normal form. The others
(2, 4, 6, 14) take up what the fragment before came to; as a rule's number tells all that
they need of it, a fold over a claim's fragments carries one number.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.functions.text import claim_logic, contains_any, modality, norm, polarity, split_claim
from corroba.operators.containment import first_containing
from corroba.operators.scratch import kept
from corroba.operators.verdicts import judge, verdict


@dataclass(frozen=True)
class Registry:
    """The names that a program goes by, in lower case."""

    tool: str = "corroba"
    env_prefix: str = "corroba_"
    commands: tuple[str, ...] = ("ground", "plan-changes", "render")
    #: Older names of the field of reference paths, and a command that is no more.
    path_aliases: tuple[str, ...] = ("reference_dir", "source_dir")
    path_field: str = "reference_paths"
    deprecated: tuple[str, ...] = ("ground-sources",)
    first_path: str = "first explicit reference path"
    language_field: str = "text_language"
    languages: tuple[str, str] = ("en", "ru")
    fields: tuple[str, ...] = ("reference_paths", "output_dir", "text_language")
    pages: tuple[str, ...] = ("overview", "architecture", "claims")
    routes: tuple[str, ...] = ("reference_alignment", "agent_alignment", "readme_alignment")
    frameworks: tuple[str, ...] = ("typer", "django", "flask")
    ignored: tuple[str, ...] = ("README.md", "**/AGENTS.md", ".git/")


# What each rule makes of a fragment: predicate, kind of subject, kind of object.
PREDICATES = {
    1: ("cli_subcommand_exists", "cli", "cli_subcommand"),
    3: ("generated_page_exists", "docs", "generated_page"),
    5: ("config_enum_contains_value", "config_field", "config_enum_value"),
    7: ("compatibility_alias_maps_to_first_reference_path", "compatibility", "compatibility_target"),
    8: ("config_alias_maps_to_field", "config_alias", "config_field"),
    9: ("ignore_policy_excludes_target", "policy", "ignore_target"),
    11: ("ignore_policy_reference_selection_independent", "policy", "reference_selection"),
    15: ("compatibility_alias_exists", "compatibility", "compatibility_alias"),
    16: ("config_field_exists", "config", "config_field"),
    17: ("route_exists", "routing", "route_name"),
    18: ("entrypoint_exists", "runtime", "entrypoint"),
    19: ("framework_hint_exists", "runtime", "framework_hint"),
    20: ("lexical_hint", "text", None),
}
# The patterns that rules look for in a normal fragment; {0} stands for the registry's names.
COMMAND = r"{0}\s+([a-z][a-z0-9-]*)"
DASHED = r"\b([a-z][a-z0-9-]*-[a-z0-9-]+)\b"
PAGE = r"(?:generated/)?([a-z_]+)\.md"
WORD = r"\b([a-z_]+)\b"
NAME = r"\b{0}\b"
MAPS_TO = r"\b{0}\b.*?maps\s+to\s+(?:the\s+)?\b([a-z_]+)\b"
FIELD = r"\b([a-z_]{4,})\b"
ENTRY = r"([a-z_][a-z0-9_.]*:[a-z_][a-z0-9_]*)"
_SAME = {2: 1, 4: 3, 6: 5, 10: 9, 12: 11, 13: 11, 14: 11}
FIRST_PATH_VALUE = "first_explicit_reference_path"
DEFAULT_TARGETS, EXPLICIT_PATHS = "default_reference_targets_independent", "explicit_reference_paths_independent"
# Where the matcher of a predicate looks, and by which rows of the rule table it is judged.
MATCHERS = {
    "cli_subcommand_exists": ("cli_subcommand", "exists_closed"),
    "config_field_exists": ("config_field", "exists_closed"),
    "config_enum_contains_value": ("config_enum_value", "enum_contains"),
    "config_alias_exists": ("config_alias", "exists_closed"),
    "config_alias_maps_to_field": ("config_alias_maps_to_field", "alias_maps"),
    "env_var_exists": ("env_var", "exists_closed"),
    "generated_page_exists": ("generated_page", "exists_closed"),
    "route_exists": ("route_name", "exists_closed"),
    "compatibility_alias_exists": ("compatibility_alias", "exists_closed"),
    "ignore_policy_excludes_target": ("ignore_policy_excludes_target", "exists_closed"),
    "ignore_policy_reference_selection_independent": ("ignore_policy_reference_selection", "policy_independent"),
    "compatibility_alias_maps_to_first_reference_path": ("compatibility_alias_maps_to_first_reference_path", "alias_first_path"),
    "entrypoint_exists": ("entrypoint", "exists_open"),
    "framework_hint_exists": ("framework_hint", "exists_open"),
    "lexical_hint": (None, "lexical"),
}


def _found(n: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.nullif(F.regexp_extract(n, pattern, group), F.lit(""))


def _all(n: Column, *words: str) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & F.contains(n, F.lit(w))
    return out


def _any_of(names: tuple[str, ...]) -> str:
    return "(" + "|".join(map(re.escape, names)) + ")"


def words_of(n: Column, r: Registry) -> Column:
    """The words that rules take from a normal fragment."""
    aliases = _any_of(r.path_aliases)
    command, page = _found(n, COMMAND.format(re.escape(r.tool))), _found(n, PAGE)
    path_alias, pair = _found(n, NAME.format(aliases)), MAPS_TO.format(aliases)
    old_name, field = _found(n, NAME.format(_any_of((*r.path_aliases, *r.deprecated)))), _found(n, FIELD)
    route, entry = _found(n, _any_of(r.routes)), _found(n, ENTRY)
    framework = F.coalesce(*(F.when(F.contains(n, F.lit(f)), F.lit(f)) for f in r.frameworks))
    language = F.when(F.contains(F.concat(F.lit(" "), n, F.lit(" ")), F.lit(f" {r.languages[1]}")), r.languages[1]).otherwise(r.languages[0])
    return F.struct(
        command.alias("command"), _found(n, DASHED).alias("dashed"), page.alias("page"), _found(n, WORD).alias("word"), language.alias("language"), n.isin(*r.languages).alias("is_language"),
        path_alias.alias("path_alias"), _found(n, pair, 1).alias("alias"), _found(n, pair, 2).alias("target"), F.contains(n, F.lit("reference")).alias("refers"), old_name.alias("old_name"), field.alias("field"),
        route.alias("route"), entry.alias("entry"), framework.alias("framework"),
    )


def rule_of(n: Column, t: Column, r: Registry) -> Column:
    """The first rule of those that look at a normal fragment alone, with its words."""
    maps = F.contains(n, F.lit("maps to"))
    speaks = F.contains(n, F.lit(r.language_field)) | (F.contains(n, F.lit("supports")) & contains_any(n, tuple(f" {v}" for v in r.languages)))
    return (
        F.when(t["command"].isNotNull(), 1)
        .when(t["page"].isNotNull(), 3)
        .when(speaks, 5)
        .when(maps & F.contains(n, F.lit(r.first_path)) & t["path_alias"].isNotNull(), 7)
        .when(maps & t["target"].isNotNull(), 8)
        .when(_all(n, "readme", "ignored", "implementation"), 9)
        .when(_all(n, "agent", "instruction", "excluded", "repo"), 10)
        .when(_all(n, "readme", "reference"), 11)
        .when(_all(n, "agent", "instruction", "reference"), 12)
        .when(_all(n, "explicit reference", "ignore"), 13)
        .when(t["old_name"].isNotNull() & ~maps, 15)
        .when(t["field"].isNotNull() & contains_any(n, ("config", "field", "env", "setting")), 16)
        .when(F.contains(n, F.lit("route")) & t["route"].isNotNull(), 17)
        .when(F.contains(n, F.lit("entrypoint")) & t["entry"].isNotNull(), 18)
        .when(t["framework"].isNotNull(), 19)
        .otherwise(20)
    )


def _after(before: Column, rule: Column, t: Column) -> Column:
    """A fragment's rule, with the rule of the one before. Rule 14 is 14 after 9 and 144 after 10:
    it takes that one's subject."""
    return (
        F.when(rule == 1, rule)
        .when(before.isin(1, 2) & t["dashed"].isNotNull(), 2)
        .when(rule == 3, rule)
        .when(before.isin(3, 4) & t["word"].isNotNull(), 4)
        .when(rule == 5, rule)
        .when(before.isin(5, 6) & t["is_language"], 6)
        .when(rule <= 13, rule)
        .when((before == 9) & t["refers"], 14)
        .when((before == 10) & t["refers"], 144)
        .otherwise(rule)
    )


def atomise(claims: DataFrame, registry: Registry = Registry(), claim: str = "claim") -> DataFrame:
    """All columns of claims with logic and, for each fragment, atom_index, fragment, rule, polarity, modality,
    predicate, subject_kind, subject, object_kind, object, anchors and aliases."""
    # each step binds what the next one uses, so that no word is looked for twice
    keys = claims.columns
    cut = claims.withColumn("logic", claim_logic(F.col(claim))).withColumn("fragments", F.transform(split_claim(F.col(claim)), lambda x: F.struct(x.alias("fragment"), norm(x).alias("n"))))
    cut = cut.withColumn("fragments", F.transform("fragments", lambda x: F.struct(x["fragment"].alias("fragment"), x["n"].alias("n"), words_of(x["n"], registry).alias("t"))))
    cut = cut.withColumn("base", F.transform("fragments", lambda x: F.struct(rule_of(x["n"], x["t"], registry).alias("rule"), x["t"].alias("t"))))
    rules = F.aggregate("base", F.array().cast("array<int>"), lambda out, x: F.concat(out, F.array(_after(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)), x["rule"], x["t"]))))
    rows = cut.withColumn("rules", rules).select(*keys, "logic", F.posexplode_outer(F.arrays_zip("fragments", "rules")).alias("atom_index", "z"))
    rows = rows.select(*keys, "logic", "atom_index", "z.fragments.fragment", "z.fragments.n", "z.fragments.t", F.col("z.rules").alias("rule"))
    return _described(rows, registry).drop("n", "t").withColumn("rule", F.when(F.col("rule") == 144, 14).otherwise(F.col("rule")))


def _described(rows: DataFrame, r: Registry) -> DataFrame:
    rule, n = F.col("rule"), F.col("n")
    lit, t = F.lit, lambda name: F.col(f"t.{name}")

    def case(values: dict[int, Column | str | None]) -> Column:
        out = F.lit(None).cast("string")
        for number, value in values.items():
            out = F.when(rule == number, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
        return out

    is_env = (rule == 16) & t("field").startswith(r.env_prefix)
    constants = {k: v for k, v in PREDICATES.items()} | {k: PREDICATES[v] for k, v in _SAME.items()} | {144: PREDICATES[11]}
    predicate, subject_kind, object_kind = (case({k: v[i] for k, v in constants.items()}) for i in range(3))
    subject = case(
        {1: r.tool, 2: r.tool, 3: "generated", 4: "generated", 5: r.language_field, 6: r.language_field, 7: t("path_alias"), 8: t("alias"), 9: "readme", 10: "agent_instruction", 11: "readme_reference_selection",
         12: "agent_instruction_reference_selection", 13: "explicit_reference_paths", 14: "readme", 144: "agent_instruction", 15: t("old_name"), 16: t("field"), 17: "routed_alignment", 18: "entrypoint",
         19: "framework", 20: F.col("fragment")}
    )
    named = case(
        {1: t("command"), 2: t("dashed"), 3: t("page"), 4: t("word"), 5: t("language"), 6: n, 7: FIRST_PATH_VALUE, 8: t("target"), 9: "README.md", 10: "**/AGENTS.md", 11: DEFAULT_TARGETS, 12: DEFAULT_TARGETS,
         13: EXPLICIT_PATHS, 14: DEFAULT_TARGETS, 144: DEFAULT_TARGETS, 15: t("old_name"), 16: t("field"), 17: t("route"), 18: t("entry"), 19: t("framework")}
    )
    tokens = F.slice(F.filter(F.split(n, " "), lambda x: F.length(x) >= 4), 1, 6)
    anchors = (
        F.when(rule.isin(1, 2), F.array(lit(r.tool), named))
        .when(rule.isin(5, 6), F.array(lit(r.language_field), named))
        .when(rule.isin(7, 8), F.array(subject, named))
        .when(rule == 9, F.array(lit("readme"), lit("ignored")))
        .when(rule == 10, F.array(lit("agents.md"), lit("excluded")))
        .when(rule == 11, F.array(lit("readme"), lit("reference"), lit("selection")))
        .when(rule == 12, F.array(lit("agent instruction"), lit("reference"), lit("selection")))
        .when(rule == 13, F.array(lit("explicit"), lit("reference"), lit("ignore")))
        .when(rule.isin(14, 144), F.array(lit("reference"), lit("selection")))
        .when(rule == 20, tokens)
        .otherwise(F.array(named))
    )
    return rows.select(
        "*", polarity(n).alias("polarity"), modality(n).alias("modality"), F.when(is_env, "env_var_exists").otherwise(predicate).alias("predicate"), subject_kind.alias("subject_kind"), subject.alias("subject"),
        F.when(is_env, "env_var").otherwise(object_kind).alias("object_kind"), named.alias("object"), anchors.alias("anchors"),
        F.when(rule.isin(7, 15), F.array(lit(r.path_field))).otherwise(F.array().cast("array<string>")).alias("aliases"),
    )


def evidence_of(spark: SparkSession, registry: Registry, code: dict[str, DataFrame] | None = None, manifest: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """ordinal, kind, value, normal, id, alias, target: what the registry and, where they are
    given, code facts, the manifest (path) and textual evidence (excerpt) tell; the first row
    of an id stays. The registry's rows are as many as its names."""
    r = registry
    rows = [("cli_command", c, None, None) for c in sorted(r.commands)] + [("cli_subcommand", c, None, None) for c in sorted(r.commands)]
    rows += [("config_field", f, None, None) for f in r.fields] + [("config_enum_value", f"{r.language_field}:{v}", None, None) for v in r.languages]
    rows += [("config_alias", a, None, None) for a in r.path_aliases] + [("config_alias_maps_to_field", f"{a}->{r.path_field}", a, r.path_field) for a in r.path_aliases]
    rows += [("compatibility_alias", a, None, None) for a in (*r.path_aliases, *r.deprecated)]
    rows += [("env_var", f"{r.env_prefix}{f}".upper(), None, None) for f in (*r.fields, *r.path_aliases)]
    rows += [("generated_page", p, None, None) for p in r.pages] + [("route_name", x, None, None) for x in r.routes] + [("ignore_policy_excludes_target", p, None, None) for p in r.ignored]
    rows += [("ignore_policy_reference_selection", x, None, None) for x in (DEFAULT_TARGETS, EXPLICIT_PATHS)]
    rows += [("compatibility_alias_maps_to_first_reference_path", f"{a}->{FIRST_PATH_VALUE}", a, FIRST_PATH_VALUE) for a in r.path_aliases]
    every = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "ordinal long, kind string, value string, alias string, target string")

    def more(found: DataFrame, kind: str, value: Column, group: int) -> DataFrame:
        place = F.lit((group + 1) << 40) + F.pmod(F.xxhash64(value), F.lit(1 << 40))
        nothing = F.lit(None).cast("string")
        return every.union(found.select(place.alias("ordinal"), F.lit(kind), value, nothing, nothing))

    if manifest is not None:
        every = more(manifest, "repo_scan_fact", F.col("path"), 0)
    if texts is not None:
        every = more(texts, "module_fact", F.replace(F.left("excerpt", F.lit(220)), F.lit("\n"), F.lit(" ")), 1)
    if code is not None:
        every = more(code["modules"], "module_fact", F.col("module_name"), 4)
        every = more(code["entrypoints"], "entrypoint", F.col("label"), 2)
        every = more(code["framework_hints"], "framework_hint", F.col("hint"), 3)
    named = every.withColumn("id", F.lower(F.replace(F.concat_ws(":", "kind", "value"), F.lit(" "), F.lit("_"))))
    first = named.groupBy("id").agg(F.min_by(F.struct("ordinal", "kind", "value", "alias", "target"), F.struct("ordinal", "value")).alias("f"))
    return first.select("f.ordinal", "f.kind", "f.value", F.lower("f.value").alias("normal"), "id", "f.alias", "f.target")


def match(atoms: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """atoms (with keys that tell them apart) judged: matcher, hit, result, tier and ids, the
    sorted ids of the evidence that decided, or up to six, in evidence order, of what a lexical atom hits.

    Atoms and evidence are made once and kept. Typed atoms join evidence by
    kind and value; the anchors of lexical atoms are looked for in evidence values, each distinct
    anchor once, through an index of the values."""
    evidence = kept(evidence, "evidence")
    kinds = F.create_map(*(F.lit(x) for p, (k, _) in MATCHERS.items() if k for x in (p, k)))
    matchers = F.create_map(*(F.lit(x) for p, (_, m) in MATCHERS.items() for x in (p, m)))
    typed = atoms.withColumn("matcher", matchers[F.col("predicate")]).withColumn("kind", kinds[F.col("predicate")])
    typed = kept(typed, "atoms")
    target = F.lower(F.coalesce("object", "subject"))
    pair = F.col("matcher").isin("alias_maps", "alias_first_path")
    enum = F.col("matcher") == "enum_contains"
    value = F.when(pair, F.concat_ws("->", F.lower("subject"), target)).when(enum, F.concat_ws(":", F.lower("subject"), target)).otherwise(target)
    # a pool row answers to its value, a relation to its two names
    known = evidence.filter(F.col("kind").isin(*{k for k, _ in MATCHERS.values() if k}))
    is_pair = F.col("alias").isNotNull()
    known = known.select("kind", "id", F.when(is_pair, F.concat_ws("->", F.lower("alias"), F.lower("target"))).otherwise(F.col("normal")).alias("answer"))
    asked = typed.filter("kind IS NOT NULL").select("kind", "matcher", value.alias("value")).distinct()
    same = (asked["kind"] == known["kind"]) & (asked["value"] == known["answer"])
    inside = (asked["kind"] == known["kind"]) & F.contains(known["answer"], asked["value"])
    exact = asked.filter("matcher <> 'enum_contains'").join(known, same).select(asked["kind"], asked["value"], "id")
    part = asked.filter("matcher = 'enum_contains'").join(known.filter("kind = 'config_enum_value'"), inside).select(asked["kind"], asked["value"], "id")
    answers = exact.union(part).groupBy("kind", "value").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    typed = typed.withColumn("value", F.when(F.col("kind").isNotNull(), value)).join(answers, ["kind", "value"], "left")

    anchored = typed.filter("matcher = 'lexical'").select(*keys, F.explode("anchors").alias("word"))
    hits = first_containing(evidence.select(F.struct("ordinal", "id").alias("place"), "normal"), "place", "normal", anchored, "word", most=6)
    # six of each word are enough for the first six of an atom
    by_word = hits.groupBy("word").agg(F.collect_list("place").alias("six"))
    lexical = anchored.join(by_word, "word").groupBy(*keys).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("six")))), 1, 6).alias("six"))
    both = typed.join(lexical.select(*keys, F.transform("six", lambda x: x["id"]).alias("hints")), keys, "left")
    found = F.coalesce("ids", "hints", F.array().cast("array<string>"))
    return judge(both.drop("kind", "value").withColumn("ids", found).drop("hints").withColumn("hit", F.size("ids") > 0))


def verdicts(judged: DataFrame, keys: list[str], route: str, verifiable: str) -> DataFrame:
    """A row a claim: verdict, supporting and contradicting (sorted ids), uncertain (whether an
    atom had lexical evidence only), atoms. Whether clauses are joined by or is not looked at."""
    decisive = F.col("tier").isin("exact", "structured_primary")
    flags = judged.groupBy(*dict.fromkeys([*keys, route, verifiable])).agg(
        F.bool_or(F.col("result") == "contradicted").alias("c"), F.bool_or((F.col("result") == "supported") & decisive).alias("s"), F.bool_or(F.col("result") == "unresolved").alias("u"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("result") != "contradicted", F.col("ids")))))).alias("supporting"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("result") == "contradicted", F.col("ids")))))).alias("contradicting"),
        F.bool_or(F.col("tier") == "lexical_secondary").alias("uncertain"), F.count("*").alias("atoms"),
    )
    told_verdict = verdict(F.col(route), F.col(verifiable), F.col("c"), F.col("s"), F.col("u"))
    return flags.select(*keys, told_verdict.alias("verdict"), "supporting", "contradicting", "uncertain", "atoms")
