"""Queries that render pages and tell small values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.functions import values as V
from corroba.operators import answers, planning, rendering
from corroba.plans.answers import HEADINGS, SECTIONS, _answers, _expected, _u
from corroba.plans.facts import _DIAG, diagnostics
from corroba.plans.registry import query, table

_NONE = "_Content unavailable after validation._"


def _page(*bodies: str) -> str:
    return "# Findings\n\nof {u}\n\n" + "\n\n".join(f"## {h}\n\n{b}" for h, b in zip(HEADINGS, bodies)) + "\n"


@query(
    _expected(
        len(SECTIONS),
        "page",
        [
            (0, _page("about {u}\n\n- point", "- **Note:** r\nk", "rest")), (1, _page("lost {u}", _NONE, "n")), (2, _page("plain words of {u}", _NONE, _NONE)),
            (3, _page("No valid structured section bodies were returned.", _NONE, _NONE)),
        ],
        _u("page"),
    )
)
def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = answers.sections(_answers(spark, sf_dir, SECTIONS), HEADINGS).withColumn("title", F.lit("Findings"))
    note = F.concat(F.lit("of "), F.col("user_id").cast("string"))
    return rendering.section_page(found.withColumn("note", note), "event_id", "title", "note", HEADINGS)


@query(
    f"""WITH d AS ({_DIAG}), p AS (SELECT code, severity, stage, count(*) AS n FROM d GROUP BY ALL),
    top AS (SELECT string_agg('- `' || code || '` (' || severity || '/' || stage || '): ' || n, chr(10) ORDER BY n DESC, code, stage, severity) AS t FROM (SELECT * FROM p ORDER BY n DESC, code, stage, severity LIMIT 5)),
    s AS (SELECT string_agg(severity || '=' || n, ', ' ORDER BY n DESC, severity) AS t FROM (SELECT severity, sum(n) AS n FROM p GROUP BY severity)),
    g AS (SELECT string_agg(stage || '=' || n, ', ' ORDER BY n DESC, stage) AS t FROM (SELECT stage, sum(n) AS n FROM p GROUP BY stage))
    SELECT '- Total diagnostics: ' || (SELECT count(*) FROM d) || chr(10) || '- Severity counts: ' || s.t || chr(10) || '- Stage counts: ' || g.t || chr(10) || '- Top diagnostic patterns:' || chr(10) || top.t AS block FROM top, s, g"""
)
def diagnostics_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.diagnostics_block(diagnostics(spark, sf_dir))


_CATEGORY = "CASE p_size % 6 WHEN 0 THEN 'readme' WHEN 1 THEN 'package_config' WHEN 2 THEN 'test_file' WHEN 3 THEN 'runtime_config' WHEN 4 THEN 'build' ELSE 'docs' END"


@query(
    f"""WITH s(section, most) AS (VALUES ('overview', 4), ('architecture', 6), ('code_structure', 7), ('runtime_entrypoints', 6), ('theory_alignment', 6)),
    e AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS path, {_CATEGORY} AS category FROM part),
    r AS (SELECT section, most, path, row_number() OVER (PARTITION BY section ORDER BY section IN ('overview', 'code_structure') AND category <> 'package_config',
      section IN ('architecture', 'code_structure', 'runtime_entrypoints') AND category = 'test_file', CASE WHEN section NOT IN ('overview', 'code_structure') THEN category END, path) AS place
      FROM e CROSS JOIN s WHERE category NOT IN ('readme', 'runtime_config'))
    SELECT section, place, path FROM r WHERE place <= most"""
)
def authoritative_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("p_size") % 6
    category = F.when(turn == 0, "readme").when(turn == 1, "package_config").when(turn == 2, "test_file").when(turn == 3, "runtime_config").when(turn == 4, "build").otherwise("docs")
    evidence = table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("path"), category.alias("category"))
    found = rendering.authoritative(evidence, ("overview", "architecture", "code_structure", "runtime_entrypoints", "theory_alignment"))
    return found.select("section", F.col("place").cast("long").alias("place"), "path")


_SETTING = "CASE event_id % 6 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'off' WHEN 2 THEN NULL WHEN 3 THEN 'a:b, c,,' || user_id WHEN 4 THEN '1' ELSE 'guide_to-' || event_type END"
_URL = "CASE event_id % 4 WHEN 0 THEN 'https://host' || user_id || '/v1' WHEN 1 THEN 'ftp://host' WHEN 2 THEN 'http://' END"


@query(
    f"""SELECT event_id, coalesce(lower(trim(s)) IN ('1', 'true', 'yes', 'on'), true) AS truth, coalesce(TRY_CAST(trim(s) AS DOUBLE), 0.5) AS number,
      CASE WHEN s IS NULL THEN '(unset)' ELSE array_to_string(list_filter(list_transform(string_split(replace(s, ':', ','), ','), lambda x: trim(x)), lambda x: x <> ''), ', ') END AS shown,
      CASE WHEN event_id % 3 = 0 THEN 'local-only' WHEN event_id % 5 <> 0 AND regexp_matches(coalesce(u, ''), '^https?://[^/?#]+') THEN 'llm-endpoint-enabled' ELSE 'llm-config-invalid' END AS mode,
      left(sha1(coalesce(s, '')), 12) AS digest, length(trim(props)) >= 24 AS usable, event_id % 7 = 0 OR contains(props, '"k": 1') AS managed,
      CASE WHEN event_id % 2 = 0 AND event_type = 'view' THEN 'Ansicht' ELSE event_type END AS label, 'logic=and; atoms=' || user_id || CASE WHEN event_id % 2 = 0 THEN '; instruction_scope=style' ELSE '' END AS rationale,
      'entities=none; evidence_ids=' || event_type || '; contradictions=none; match_trace=t' || CASE WHEN event_id % 2 = 0 THEN '; uncertainty=low' ELSE '' END AS note FROM (SELECT *, {_SETTING} AS s, {_URL} AS u FROM events)"""
)
def setting_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    event, user = F.col("event_id"), F.col("user_id").cast("string")
    turn, fourth, even = event % 6, event % 4, event % 2 == 0
    s = F.when(turn == 0, " Yes ").when(turn == 1, "off").when(turn == 2, None).when(turn == 3, F.concat(F.lit("a:b, c,,"), user)).when(turn == 4, "1").otherwise(F.concat(F.lit("guide_to-"), "event_type"))
    u = F.when(fourth == 0, F.concat(F.lit("https://host"), user, F.lit("/v1"))).when(fourth == 1, "ftp://host").when(fourth == 2, "http://")
    rows = table(spark, sf_dir, "events").withColumn("s", s).withColumn("u", u)
    s, u, none = F.col("s"), F.col("u"), F.array().cast("array<string>")
    return rows.select(
        "event_id", V.as_bool(s, True).alias("truth"), V.as_number(s, 0.5).alias("number"), V.as_text(V.split_many(s)).alias("shown"),
        V.privacy_mode(event % 3 != 0, F.when(event % 5 != 0, "model"), u).alias("mode"), V.prompt_digest(F.coalesce(s, F.lit(""))).alias("digest"), V.usable(F.col("props")).alias("usable"),
        V.managed(F.when(event % 7 == 0, "").otherwise(F.col("props")), ('"k": 1',)).alias("managed"), V.label(F.when(even, "de").otherwise("en"), F.col("event_type"), {"de": {"view": "Ansicht"}}, F.col("event_type")).alias("label"),
        V.rationale(F.lit("and"), F.col("user_id"), F.when(even, "style")).alias("rationale"), V.evidence_note(none, F.array("event_type"), none, F.lit("t"), F.when(even, "low")).alias("note"),
    )


@query(
    """WITH changed AS (SELECT o_custkey AS k, CASE o_orderstatus WHEN 'F' THEN 'src/a.py' WHEN 'O' THEN 'ref/b.md' ELSE 'x/y' END AS path FROM orders WHERE o_orderpriority <> '5-LOW'
      UNION ALL SELECT o_custkey, CASE WHEN o_orderkey % 9 = 0 THEN 'mkdocs.yml' WHEN o_orderkey % 9 = 1 THEN 'docs/a.md' ELSE 'other' END FROM orders WHERE o_orderpriority = '5-LOW'),
    f AS (SELECT k, bool_or(starts_with(path, 'src/')) AS s, bool_or(starts_with(path, 'ref/')) AS r, bool_or(starts_with(path, 'docs/') OR path = 'mkdocs.yml') AS d, count(*) AS n FROM changed GROUP BY k)
    SELECT k, 'Update plan' || chr(10) || 'changed files: ' || n || chr(10) || 'source_changed: ' || s || chr(10) || 'reference_changed: ' || r || chr(10) || 'docs_or_config_changed: ' || d || chr(10) || 'full regeneration: true' || chr(10) || 'reason: '
      || CASE WHEN d THEN 'documentation or configuration changed' WHEN s AND r THEN 'source and reference changed' WHEN s THEN 'source changed' WHEN r THEN 'reference changed' ELSE 'unrelated changes' END AS text FROM f"""
)
def plan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, low, turn = F.col("o_orderstatus"), F.col("o_orderpriority") == "5-LOW", F.col("o_orderkey") % 9
    path = F.when(low & (turn == 0), "mkdocs.yml").when(low & (turn == 1), "docs/a.md").when(low, "other").when(status == "F", "src/a.py").when(status == "O", "ref/b.md").otherwise("x/y")
    changed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), path.alias("path"))
    plan = planning.change_plan(changed, ["k"], ("src",), ("ref",), ("docs",), F.col("path").isin(*planning.CONFIG_FILES))
    return planning.plan_text(plan).select("k", "text")
