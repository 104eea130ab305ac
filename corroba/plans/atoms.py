"""Claims end to end: sentences, atoms, evidence, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.functions import text as T
from corroba.operators import atoms as A
from corroba.operators.claims import classify
from corroba.operators.verdicts import RULES
from corroba.plans.registry import query, spread_table, table
from corroba.plans.texts import norm_sql, split_sql

#: The program that the sentences speak of: some of its names are market segments of customers.
REGISTRY = A.Registry(commands=("building", "ground", "plan-changes"), fields=("reference_paths", "automobile", "machinery"), pages=("overview", "claims", "furniture"))

#: What customers claim, by their keys; {s} is the market segment in lower case, {u} in upper case.
SENTENCES = (
    "Run corroba {s} before release and {s}-all", "Do not run corroba ground, plan-changes", "It writes generated/{s}.md and claims", "The overview.md page is not there", "text_language supports en, ru",
    "It supports de but not en", "source_dir maps to the first explicit reference path", "reference_dir maps to the reference_paths", "reference_dir never maps to {s}",
    "README files are ignored for the implementation, reference files stay", "Agent instruction files must be excluded from the repo and their reference is kept", "The README is no reference",
    "An agent instruction is a reference", "Explicit reference paths ignore the list", "ground-sources and source_dir should stay", "{s} is a config field", "The env CORROBA_{u} is required",
    "The route readme_alignment is shown", "The entrypoint pkg.cli:main is there, without route", "Built with Django or flask", "Customers of {s} buy more than others", "It is quite fast and easy to use",
    " ; ", "Straße and KK config, never forbidden",
)
_ROUTE = "CASE c_custkey % 3 WHEN 0 THEN 'agent' WHEN 1 THEN 'readme' ELSE 'general' END"


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, route, claim of all customers."""
    key, turn = F.col("c_custkey"), F.col("c_custkey") % 3
    template = F.element_at(F.array(*map(F.lit, SENTENCES)), (key % len(SENTENCES) + 1).cast("int"))
    claim = F.replace(F.replace(template, F.lit("{s}"), F.lower("c_mktsegment")), F.lit("{u}"), F.upper("c_mktsegment"))
    route = F.when(turn == 0, "agent").when(turn == 1, "readme").otherwise("general")
    return spread_table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").select(key.alias("claim_id"), route.alias("route"), claim.alias("claim"))


def _texts(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_R = REGISTRY
_ALIASES = "(" + "|".join(_R.path_aliases) + ")"
_PAIR = rf"\b{_ALIASES}\b.*?maps\s+to\s+(?:the\s+)?\b([a-z_]+)\b"
_OLD = r"\b(" + "|".join((*_R.path_aliases, *_R.deprecated)) + r")\b"
_HAS = {w: f"contains(n, '{w}')" for w in "config field env setting readme ignored implementation agent instruction excluded repo reference route entrypoint supports".split()}
_BASE = rf"""CASE WHEN regexp_matches(n, '{_R.tool}\s+[a-z][a-z0-9-]*') THEN 1 WHEN regexp_matches(n, '[a-z_]+\.md') THEN 3
      WHEN contains(n, '{_R.language_field}') OR ({_HAS['supports']} AND (contains(n, ' en') OR contains(n, ' ru'))) THEN 5
      WHEN contains(n, 'maps to') AND contains(n, '{_R.first_path}') AND regexp_matches(n, '\b{_ALIASES}\b') THEN 7 WHEN contains(n, 'maps to') AND regexp_matches(n, '{_PAIR}') THEN 8
      WHEN {_HAS['readme']} AND {_HAS['ignored']} AND {_HAS['implementation']} THEN 9 WHEN {_HAS['agent']} AND {_HAS['instruction']} AND {_HAS['excluded']} AND {_HAS['repo']} THEN 10
      WHEN {_HAS['readme']} AND {_HAS['reference']} THEN 11 WHEN {_HAS['agent']} AND {_HAS['instruction']} AND {_HAS['reference']} THEN 12
      WHEN contains(n, 'explicit reference') AND contains(n, 'ignore') THEN 13 WHEN regexp_matches(n, '{_OLD}') AND NOT contains(n, 'maps to') THEN 15
      WHEN regexp_matches(n, '\b[a-z_]{{4,}}\b') AND ({_HAS['config']} OR {_HAS['field']} OR {_HAS['env']} OR {_HAS['setting']}) THEN 16
      WHEN {_HAS['route']} AND regexp_matches(n, '({'|'.join(_R.routes)})') THEN 17 WHEN {_HAS['entrypoint']} AND regexp_matches(n, '[a-z_][a-z0-9_.]*:[a-z_][a-z0-9_]*') THEN 18
      WHEN contains(n, 'typer') OR contains(n, 'django') OR contains(n, 'flask') THEN 19 ELSE 20 END"""
_ATOMS = rf"""RECURSIVE claims AS (
      SELECT c_custkey AS claim_id, {_ROUTE} AS route, replace(replace({_texts(SENTENCES)}[CAST(c_custkey % {len(SENTENCES)} AS INTEGER) + 1], '{{s}}', lower(c_mktsegment)), '{{u}}', upper(c_mktsegment)) AS claim FROM customer
    ), cut AS (
      SELECT claim_id, route, claim, CASE WHEN contains(low, ' or ') THEN 'or' WHEN contains(low, ' and ') OR contains(low, ' but ') OR contains(low, ',') THEN 'and' ELSE 'single' END AS logic,
        {split_sql('claim')} AS q FROM (SELECT *, translate(claim, '{T.UPPER}', '{T.LOWER}') AS low FROM claims)
    ), fragments AS (
      SELECT claim_id, route, claim, logic, i, p[i] AS fragment, {norm_sql('p[i]')} AS n FROM (SELECT *, CASE WHEN len(q) > 0 THEN q ELSE [claim] END AS p FROM cut), unnest(range(1, len(p) + 1)) AS u(i)
    ), based AS (SELECT *, {_BASE} AS base FROM fragments),
    ruled AS (
      SELECT claim_id, CAST(0 AS BIGINT) AS i, 0 AS rule FROM claims
      UNION ALL
      SELECT b.claim_id, b.i, CASE WHEN base = 1 THEN 1 WHEN r.rule IN (1, 2) AND regexp_matches(n, '\b[a-z][a-z0-9-]*-[a-z0-9-]+\b') THEN 2 WHEN base = 3 THEN 3
        WHEN r.rule IN (3, 4) AND regexp_matches(n, '\b[a-z_]+\b') THEN 4 WHEN base = 5 THEN 5 WHEN r.rule IN (5, 6) AND n IN ('en', 'ru') THEN 6 WHEN base <= 13 THEN base
        WHEN r.rule = 9 AND contains(n, 'reference') THEN 14 WHEN r.rule = 10 AND contains(n, 'reference') THEN 144 ELSE base END
      FROM ruled AS r JOIN based AS b ON b.claim_id = r.claim_id AND b.i = r.i + 1
    ), named AS (
      SELECT b.*, rule, CASE WHEN rule = 1 THEN regexp_extract(n, '{_R.tool}\s+([a-z][a-z0-9-]*)', 1) WHEN rule = 2 THEN regexp_extract(n, '\b([a-z][a-z0-9-]*-[a-z0-9-]+)\b', 1)
          WHEN rule = 3 THEN regexp_extract(n, '([a-z_]+)\.md', 1) WHEN rule = 4 THEN regexp_extract(n, '\b([a-z_]+)\b', 1) WHEN rule = 5 THEN CASE WHEN contains(' ' || n || ' ', ' ru') THEN 'ru' ELSE 'en' END
          WHEN rule = 6 THEN n WHEN rule = 7 THEN '{A.FIRST_PATH_VALUE}' WHEN rule = 8 THEN regexp_extract(n, '{_PAIR}', 2) WHEN rule = 9 THEN 'README.md' WHEN rule = 10 THEN '**/AGENTS.md'
          WHEN rule = 13 THEN '{A.EXPLICIT_PATHS}' WHEN rule IN (11, 12, 14, 144) THEN '{A.DEFAULT_TARGETS}' WHEN rule = 15 THEN regexp_extract(n, '{_OLD}', 1)
          WHEN rule = 16 THEN regexp_extract(n, '\b([a-z_]{{4,}})\b', 1) WHEN rule = 17 THEN regexp_extract(n, '({'|'.join(_R.routes)})', 1)
          WHEN rule = 18 THEN regexp_extract(n, '([a-z_][a-z0-9_.]*:[a-z_][a-z0-9_]*)', 1) WHEN rule = 19 THEN CASE WHEN contains(n, 'typer') THEN 'typer' WHEN contains(n, 'django') THEN 'django' ELSE 'flask' END END AS object,
        CASE WHEN rule IN (1, 2) THEN '{_R.tool}' WHEN rule IN (3, 4) THEN 'generated' WHEN rule IN (5, 6) THEN '{_R.language_field}' WHEN rule = 7 THEN regexp_extract(n, '\b{_ALIASES}\b', 1)
          WHEN rule = 8 THEN regexp_extract(n, '{_PAIR}', 1) WHEN rule IN (9, 14) THEN 'readme' WHEN rule IN (10, 144) THEN 'agent_instruction' WHEN rule = 11 THEN 'readme_reference_selection'
          WHEN rule = 12 THEN 'agent_instruction_reference_selection' WHEN rule = 13 THEN 'explicit_reference_paths' WHEN rule = 15 THEN regexp_extract(n, '{_OLD}', 1)
          WHEN rule = 16 THEN regexp_extract(n, '\b([a-z_]{{4,}})\b', 1) WHEN rule = 17 THEN 'routed_alignment' WHEN rule = 18 THEN 'entrypoint' WHEN rule = 19 THEN 'framework' ELSE fragment END AS subject
      FROM based AS b JOIN ruled AS r USING (claim_id, i)
    ), atoms AS (
      SELECT *, CASE WHEN {' OR '.join(f"contains(' ' || n || ' ', ' {w} ')" for w in T.NEGATIONS)} THEN 'negative' ELSE 'positive' END AS polarity,
        CASE {' '.join('WHEN ' + ' OR '.join(f"contains(n, '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in T.MODALITIES)} ELSE 'descriptive' END AS modality,
        CASE WHEN rule IN (1, 2) THEN 'cli_subcommand_exists' WHEN rule IN (3, 4) THEN 'generated_page_exists' WHEN rule IN (5, 6) THEN 'config_enum_contains_value'
          WHEN rule = 7 THEN 'compatibility_alias_maps_to_first_reference_path' WHEN rule = 8 THEN 'config_alias_maps_to_field' WHEN rule IN (9, 10) THEN 'ignore_policy_excludes_target'
          WHEN rule IN (11, 12, 13, 14, 144) THEN 'ignore_policy_reference_selection_independent' WHEN rule = 15 THEN 'compatibility_alias_exists'
          WHEN rule = 16 THEN CASE WHEN starts_with(object, '{_R.env_prefix}') THEN 'env_var_exists' ELSE 'config_field_exists' END WHEN rule = 17 THEN 'route_exists' WHEN rule = 18 THEN 'entrypoint_exists'
          WHEN rule = 19 THEN 'framework_hint_exists' ELSE 'lexical_hint' END AS predicate,
        CASE WHEN rule IN (1, 2) THEN ['{_R.tool}', object] WHEN rule IN (5, 6, 7, 8) THEN [subject, object] WHEN rule = 9 THEN ['readme', 'ignored'] WHEN rule = 10 THEN ['agents.md', 'excluded']
          WHEN rule = 11 THEN ['readme', 'reference', 'selection'] WHEN rule = 12 THEN ['agent instruction', 'reference', 'selection'] WHEN rule = 13 THEN ['explicit', 'reference', 'ignore']
          WHEN rule IN (14, 144) THEN ['reference', 'selection'] WHEN rule = 20 THEN list_filter(string_split(n, ' '), lambda x: length(x) >= 4)[1:6] ELSE [object] END AS anchors
      FROM named
    )"""


@query(
    f"""WITH {_ATOMS} SELECT claim_id, CAST(i - 1 AS BIGINT) AS atom_index, logic, fragment, CASE WHEN rule = 144 THEN 14 ELSE rule END AS rule, polarity, modality, predicate, subject, object,
    CASE WHEN rule IN (1, 2) THEN 'cli' WHEN rule IN (3, 4) THEN 'docs' WHEN rule IN (5, 6) THEN 'config_field' WHEN rule IN (7, 15) THEN 'compatibility' WHEN rule = 8 THEN 'config_alias'
      WHEN rule IN (9, 10, 11, 12, 13, 14, 144) THEN 'policy' WHEN rule = 16 THEN 'config' WHEN rule = 17 THEN 'routing' WHEN rule IN (18, 19) THEN 'runtime' ELSE 'text' END AS subject_kind,
    array_to_string(anchors, '|') AS anchors FROM atoms"""
)
def claim_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.atomise(sentences(spark, sf_dir), REGISTRY)
    columns = ("logic", "fragment", "rule", "polarity", "modality", "predicate", "subject", "object", "subject_kind")
    return found.select("claim_id", F.col("atom_index").cast("long").alias("atom_index"), *columns, F.array_join("anchors", "|").alias("anchors"))


def _pool() -> str:
    """The registry's evidence, kind by kind as the survey lists it, as rows of VALUES."""
    r = REGISTRY
    rows = [("cli_command", c) for c in sorted(r.commands)] + [("cli_subcommand", c) for c in sorted(r.commands)] + [("config_field", f) for f in r.fields]
    rows += [("config_enum_value", f"{r.language_field}:{v}") for v in r.languages] + [("config_alias", a) for a in r.path_aliases]
    rows += [("config_alias_maps_to_field", f"{a}->{r.path_field}") for a in r.path_aliases] + [("compatibility_alias", a) for a in (*r.path_aliases, *r.deprecated)]
    rows += [("env_var", f"{r.env_prefix}{f}".upper()) for f in (*r.fields, *r.path_aliases)] + [("generated_page", p) for p in r.pages] + [("route_name", x) for x in r.routes]
    rows += [("ignore_policy_excludes_target", p) for p in r.ignored] + [("ignore_policy_reference_selection", x) for x in (A.DEFAULT_TARGETS, A.EXPLICIT_PATHS)]
    rows += [("compatibility_alias_maps_to_first_reference_path", f"{a}->{A.FIRST_PATH_VALUE}") for a in r.path_aliases]
    return ", ".join(f"({i}, '{k}', '{v.lower()}', '{f'{k}:{v}'.replace(' ', '_').lower()}')" for i, (k, v) in enumerate(rows))


_OUTCOMES = ", ".join(f"('{m}', {str(h).lower()}, '{p}', '{r}', '{t}')" for m, h, p, r, t in RULES)


@query(
    f"""WITH {_ATOMS}, pool(o, kind, normal, id) AS (VALUES {_pool()}), outcomes(matcher, hit, polarity, result, tier) AS (VALUES {_OUTCOMES}),
    asked AS (
      SELECT *, CASE predicate WHEN 'cli_subcommand_exists' THEN 'cli_subcommand' WHEN 'config_field_exists' THEN 'config_field' WHEN 'config_enum_contains_value' THEN 'config_enum_value'
          WHEN 'env_var_exists' THEN 'env_var' WHEN 'generated_page_exists' THEN 'generated_page' WHEN 'route_exists' THEN 'route_name' WHEN 'compatibility_alias_exists' THEN 'compatibility_alias'
          WHEN 'ignore_policy_reference_selection_independent' THEN 'ignore_policy_reference_selection' WHEN 'entrypoint_exists' THEN 'entrypoint' WHEN 'framework_hint_exists' THEN 'framework_hint' ELSE predicate END AS kind,
        CASE WHEN predicate = 'config_enum_contains_value' THEN 'enum_contains' WHEN predicate = 'config_alias_maps_to_field' THEN 'alias_maps' WHEN predicate = 'lexical_hint' THEN 'lexical'
          WHEN predicate = 'compatibility_alias_maps_to_first_reference_path' THEN 'alias_first_path' WHEN predicate = 'ignore_policy_reference_selection_independent' THEN 'policy_independent'
          WHEN predicate IN ('entrypoint_exists', 'framework_hint_exists') THEN 'exists_open' ELSE 'exists_closed' END AS matcher FROM atoms
    ), hits AS (
      SELECT a.claim_id, a.i, p.o, p.id FROM asked AS a JOIN pool AS p ON CASE a.matcher WHEN 'lexical' THEN len(list_filter(a.anchors, lambda x: contains(p.normal, x))) > 0
        WHEN 'enum_contains' THEN p.kind = a.kind AND contains(p.normal, a.subject || ':' || a.object) WHEN 'alias_maps' THEN p.kind = a.kind AND p.normal = a.subject || '->' || a.object
        WHEN 'alias_first_path' THEN p.kind = a.kind AND p.normal = a.subject || '->' || a.object ELSE p.kind = a.kind AND p.normal = lower(a.object) END
    ), six AS (SELECT claim_id, i, list(id ORDER BY o) AS ids FROM hits GROUP BY ALL),
    judged AS (
      SELECT a.claim_id, a.route, a.claim, u.result, u.tier, CASE WHEN a.matcher = 'lexical' THEN coalesce(s.ids, [])[1:6] ELSE coalesce(s.ids, []) END AS ids
      FROM asked AS a LEFT JOIN six AS s USING (claim_id, i) JOIN outcomes AS u ON u.matcher = a.matcher AND u.hit = (s.ids IS NOT NULL) AND u.polarity = a.polarity
    ), flags AS (
      SELECT claim_id, route, {norm_sql('claim')} AS n, bool_or(result = 'contradicted') AS c, bool_or(result = 'supported' AND tier IN ('exact', 'structured_primary')) AS s, bool_or(result = 'unresolved') AS u,
        flatten(list(CASE WHEN result <> 'contradicted' THEN ids ELSE [] END)) AS supporting, flatten(list(CASE WHEN result = 'contradicted' THEN ids ELSE [] END)) AS contradicting,
        bool_or(tier = 'lexical_secondary') AS uncertain, count(*) AS atoms FROM judged GROUP BY claim_id, route, claim
    ), told AS (
      SELECT *, CASE route WHEN 'agent' THEN NOT (contains(n, 'tone') OR contains(n, 'high quality') OR contains(n, 'be concise') OR contains(n, 'be polite') OR contains(n, 'think step by step'))
        WHEN 'readme' THEN NOT (contains(n, 'fast') OR contains(n, 'easy') OR contains(n, 'quality') OR contains(n, 'reliable') OR contains(n, 'latency') OR contains(n, 'perform')) ELSE true END AS verifiable FROM flags
    )
    SELECT claim_id, route, CASE WHEN route = 'agent' AND NOT verifiable THEN 'out_of_scope_or_non_verifiable' WHEN route = 'readme' AND NOT verifiable THEN 'not_statically_verifiable'
      WHEN c THEN 'contradicted' WHEN s AND NOT u THEN 'supported' WHEN s AND u THEN 'partially_supported' WHEN route = 'general' THEN 'missing_evidence' ELSE 'not_evidenced' END AS verdict,
      array_to_string(list_sort(list_distinct(supporting)), ',') AS supporting, array_to_string(list_sort(list_distinct(contradicting)), ',') AS contradicting, uncertain, atoms FROM told"""
)
def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's sentence: its atoms against the registry's evidence, and the verdict."""
    claims = sentences(spark, sf_dir).withColumn("n", T.norm("claim")).withColumn("verifiable", classify(F.col("route"), F.col("n"))["verifiable"]).drop("n")
    judged = A.match(A.atomise(claims, REGISTRY), A.evidence_of(spark, REGISTRY), ["claim_id", "atom_index"])
    found = A.verdicts(judged, ["claim_id", "route"], "route", "verifiable")
    joined = [F.array_join(c, ",").alias(c) for c in ("supporting", "contradicting")]
    return found.select("claim_id", "route", "verdict", *joined, "uncertain", "atoms")
