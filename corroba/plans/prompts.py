"""What sections show of a corpus, and their prompts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.operators import prompts as P
from corroba.operators.codefacts import select_facts
from corroba.operators.rendering import authoritative
from corroba.plans.facts import _code
from corroba.plans.pages import _CATEGORY
from corroba.plans.registry import ORACLE_SQL, query, table

#: The eight sections with words that the documents have, beside words that their hints have.
_WORDS = {
    "overview": ("overview", "the", "para", "und"), "architecture": ("architecture", "module", "tion", "ung"), "code_structure": ("structure", "ing", "del", "est"), "runtime_entrypoints": ("main", "src1", "with", "pour"),
    "theory_alignment": ("alignment", "that", "der", "que", "en.md"), "reference_alignment": ("reference", "alignment", "claim", "ción"), "agent_instruction_alignment": ("agent", "config", "von", "ou"), "readme_claim_alignment": ("readme", "claim", "ll", "%%%"),
}
SECTIONS = tuple(replace(s, keywords=_WORDS[s.name]) for s in P.SECTIONS)
_HINT = "CASE doc_id % 6 WHEN 0 THEN 'Overview' WHEN 1 THEN 'On code-structure and modules' WHEN 2 THEN 'Reference Alignment of claims' WHEN 3 THEN upper(lang) WHEN 4 THEN 'main' END"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of the file of their source and language."""
    turn = F.col("doc_id") % 6
    hint = F.when(turn == 0, "Overview").when(turn == 1, "On code-structure and modules").when(turn == 2, "Reference Alignment of claims").when(turn == 3, F.upper("lang")).when(turn == 4, "main")
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.col("doc_id").alias("chunk_index"), F.concat(path, F.lit(":"), F.col("doc_id").cast("string")).alias("chunk_id"), "text", hint.alias("section_hint"))


def _sql_of(sections: tuple[P.Section, ...]) -> str:
    rows = ", ".join(f"('{s.name}', {s.most}, {s.total}, {s.each}, [{', '.join(repr(k) for k in s.keywords)}])" for s in sections)
    return f"""s(section, most, total, each, words) AS (VALUES {rows}),
    c AS (SELECT source || '/' || lang || '.md' AS path, doc_id, text, {_HINT} AS hint FROM documents),
    scored AS (SELECT section, most, total, each, path, doc_id, length(text) AS n, hint, text,
        5 * len(list_filter(words, lambda w: contains(lower(path) || ' ' || lower(coalesce(hint, '')) || ' ' || lower(left(text, 400)), w)))
        + CASE WHEN contains(replace(lower(coalesce(hint, '')), '-', '_'), section) THEN 6 ELSE 0 END AS score FROM c CROSS JOIN s),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, path, doc_id) AS r FROM scored),
    walk AS (
      SELECT section, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS spent, CAST(0 AS BIGINT) AS picked, CAST(NULL AS BIGINT) AS doc_id FROM s
      UNION ALL
      SELECT x.section, x.r, CASE WHEN w.picked < x.most AND w.spent + least(x.n, x.each) <= x.total THEN w.spent + least(x.n, x.each) ELSE w.spent END,
        CASE WHEN w.picked < x.most AND w.spent + least(x.n, x.each) <= x.total THEN w.picked + 1 ELSE w.picked END,
        CASE WHEN w.picked < x.most AND w.spent + least(x.n, x.each) <= x.total THEN x.doc_id END
      FROM walk AS w JOIN ranked AS x ON x.section = w.section AND x.r = w.r + 1
    ),
    taken AS (SELECT section, picked AS place, spent AS total, doc_id FROM walk WHERE doc_id IS NOT NULL)"""


@query(f"WITH RECURSIVE {_sql_of(SECTIONS)} SELECT section, doc_id, CAST(score AS BIGINT) AS score FROM scored")
def chunk_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document for every section: keywords in path, hint and opening, one pass for all of them."""
    return P.relevance(_chunks(spark, sf_dir), SECTIONS, scanned=True).select("section", F.col("chunk_index").alias("doc_id"), "score")


@query(f"WITH RECURSIVE {_sql_of(SECTIONS)} SELECT section, place, total, doc_id FROM taken")
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.selected(_chunks(spark, sf_dir), SECTIONS, scanned=True).select("section", "place", "total", F.col("chunk_index").alias("doc_id"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _prompts_sql() -> str:
    shown = ORACLE_SQL["section_budget_topk"].split("SELECT section, 'modules' AS kind")
    code = shown[0].removeprefix("WITH ").rstrip()
    facts = "SELECT section, 'modules' AS kind" + shown[1]
    routes = ", ".join(f"({_text(s.name)}, {_text(s.route)})" for s in SECTIONS if s.route)
    fixed = ", ".join(f"({_text(s.name)}, {_text(P.task(s))}, {_text(P.answer_form(s))})" for s in SECTIONS)
    kinds = "(4, 'modules'), (5, 'symbols'), (6, 'imports'), (7, 'entrypoints'), (8, 'excerpts')"
    return f"""WITH RECURSIVE {_sql_of(SECTIONS)}, {code}, code_items AS ({facts}), kinds(block, kind) AS (VALUES {kinds}), fixed(section, task, answer) AS (VALUES {fixed}), routes(section, route) AS (VALUES {routes}),
    evidence AS (SELECT * FROM (SELECT section, e.*, row_number() OVER (PARTITION BY section ORDER BY section IN ('overview', 'code_structure') AND category <> 'package_config',
        section IN ('architecture', 'code_structure', 'runtime_entrypoints') AND category = 'test_file', CASE WHEN section NOT IN ('overview', 'code_structure') THEN category END, path) AS place
      FROM (SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS path, {_CATEGORY} AS category, p_name AS excerpt, p_size AS lines FROM part) AS e CROSS JOIN s WHERE category NOT IN ('readme', 'runtime_config'))
      WHERE place <= CASE section WHEN 'overview' THEN 4 WHEN 'code_structure' THEN 7 ELSE 6 END),
    sources AS (SELECT source || '/' || lang || '.md' AS path, CAST(sum(octet_length(encode(text))) AS BIGINT) AS size FROM documents GROUP BY 1),
    listed AS (SELECT string_agg('- ' || path || ' (.md, ' || size || ' bytes)', chr(10) ORDER BY path) AS t FROM sources),
    materials AS (SELECT * FROM (SELECT section, route, conv_id, turn, text, row_number() OVER (PARTITION BY section ORDER BY conv_id, turn) AS place FROM routes JOIN (SELECT *, CASE role WHEN 'user' THEN 'general_reference_alignment'
      WHEN 'assistant' THEN 'agent_instruction_alignment' ELSE 'nothing' END AS route FROM conversations) USING (route)) WHERE place <= 10),
    parts AS (
      SELECT section, 0 AS block, task AS t FROM fixed
      UNION ALL SELECT section, 1, '[FACTS OF THE SCAN]' || chr(10) || (SELECT string_agg('region ' || r_name || ': ' || n, chr(10) ORDER BY r_regionkey)
        FROM (SELECT r_regionkey, r_name, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL)) FROM s
      UNION ALL SELECT section, 2, '[EVIDENCE: ' || count(*) || ']' || chr(10) || chr(10) || string_agg('## ' || category || ': ' || path || chr(10) || 'lines: ' || lines || chr(10) || excerpt, chr(10) || chr(10) ORDER BY place) FROM evidence GROUP BY section
      UNION ALL SELECT section, 3, '[REFERENCES]' || chr(10) || t FROM s, listed
      UNION ALL SELECT section, block, '[' || upper(kind) || ': ' || count(item) || ']' || chr(10) || coalesce(string_agg('- ' || item, chr(10) ORDER BY place), '- None')
        FROM (SELECT section, block, kind FROM s, kinds) LEFT JOIN code_items USING (section, kind) GROUP BY section, block, kind
      UNION ALL SELECT section, 9, answer FROM fixed
      UNION ALL SELECT section, 10, '[REFERENCE CHUNKS: ' || count(*) || ' of at most ' || any_value(s.most) || ', ' || any_value(s.each) || ' characters each, ' || any_value(s.total) || ' in all]' || chr(10) || chr(10) || string_agg('[CHUNK ' || place || '] ' || path || ':' || doc_id || chr(10)
        || 'source: ' || path || chr(10) || 'hint: ' || coalesce(hint, '(none)') || chr(10) || left(text, each), chr(10) || chr(10) ORDER BY place) FROM taken JOIN s USING (section) JOIN c USING (doc_id) GROUP BY section
      UNION ALL SELECT section, 11, '[MATERIAL OF ' || route || ': ' || count(*) || ']' || chr(10) || chr(10) || string_agg('## item ' || place || chr(10) || 'source: conversation ' || conv_id || chr(10) || 'hint: ' || turn || chr(10) || text, chr(10) || chr(10) ORDER BY place)
        FROM materials GROUP BY section, route
    ) SELECT section, string_agg(t, chr(10) || chr(10) ORDER BY block) AS prompt FROM parts GROUP BY section"""


@query(_prompts_sql())
def section_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of all sections: documents as chunks and references, parts as evidence, line items as code,
    conversations as materials of the routes."""
    documents, part = table(spark, sf_dir, "documents"), table(spark, sf_dir, "part")
    turn, key = F.col("p_size") % 6, F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    category = F.when(turn == 0, "readme").when(turn == 1, "package_config").when(turn == 2, "test_file").when(turn == 3, "runtime_config").when(turn == 4, "build").otherwise("docs")
    offered = part.select(key.alias("path"), category.alias("category"), F.col("p_size").alias("line_count"), F.col("p_name").alias("excerpt"))
    shown = authoritative(offered.select("path", "category"), tuple(s.name for s in SECTIONS))
    evidence = offered.join(F.broadcast(shown), "path")  # a few rows a section
    sources = documents.groupBy(F.concat("source", F.lit("/"), "lang", F.lit(".md")).alias("path")).agg(F.sum(F.octet_length("text")).alias("size_bytes")).withColumn("extension", F.lit(".md"))
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    facts = region.join(nation, nation["n_regionkey"] == region["r_regionkey"], "left").groupBy("r_regionkey", "r_name").agg(F.count("n_nationkey").alias("n"))
    facts = facts.select(F.col("r_regionkey").alias("place"), F.concat(F.lit("region "), "r_name", F.lit(": "), F.col("n").cast("string")).alias("line"))
    found, text = select_facts(*_code(spark, sf_dir)), lambda c: F.col(c).cast("string")
    item = {
        "modules": text("module_name"), "symbols": F.concat_ws(":", text("module_name"), text("lineno"), "symbol_name"), "imports": F.concat_ws(">", text("source_module"), "imported_module"),
        "entrypoints": F.col("label"), "excerpts": F.concat_ws(":", text("module_name"), text("start_line")),
    }
    code = {k: found[k].select("section", "place", F.concat(F.lit("- "), v).alias("line")) for k, v in item.items()}
    role = F.col("role")
    materials = table(spark, sf_dir, "conversations").select(
        F.when(role == "user", "general_reference_alignment").when(role == "assistant", "agent_instruction_alignment").otherwise("nothing").alias("route"), F.struct("conv_id", "turn").alias("ordinal"),
        F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("source_path"), F.col("turn").cast("string").alias("section_hint"), F.col("text").alias("excerpt"),
    )
    return P.prompts(_chunks(spark, sf_dir), facts, evidence, sources, code, materials, SECTIONS, scanned=True)
