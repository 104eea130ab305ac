"""Queries over paths: resolved ones, roots above them, and small values of paths and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.functions import values as V
from corroba.operators import answers, paths
from corroba.operators.discovery import display_path
from corroba.plans.answers import evidence_pack
from corroba.plans.registry import ORACLE_SQL, query, table

_PATH = "regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)"
_WALK = f"CASE page_id % 4 WHEN 0 THEN {_PATH} || '/../' || page_id % 10 || '/./x//y/..' WHEN 1 THEN substr({_PATH}, 2) || '/' WHEN 2 THEN '../../..' || {_PATH} || '/.' ELSE {_PATH} || '/a/b/../../c' END"


def _path() -> Column:
    return F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)


@query(
    f"""WITH walks AS (SELECT page_id, {_WALK} AS p FROM pages), steps AS (
      SELECT page_id, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(string_split(CASE WHEN starts_with(p, '/') THEN p ELSE '/srv/www/' || p END, '/'), lambda s: [s])),
        lambda held, x: CASE WHEN x[1] IN ('', '.') THEN held WHEN x[1] = '..' THEN held[1:len(held) - 1] ELSE list_concat(held, x) END) AS held FROM walks
    ), told AS (SELECT page_id, '/' || array_to_string(held, '/') AS path FROM steps)
    SELECT path, min(page_id) AS page_id, count(*) AS n, CASE WHEN starts_with(path, '/srv/www/') THEN substr(path, 10) ELSE path END AS shown FROM told GROUP BY path"""
)
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by what they come to: each once, with the first page that names it."""
    turn, path = F.col("page_id") % 4, _path()
    walk = F.when(turn == 0, F.concat(path, F.lit("/../"), (F.col("page_id") % 10).cast("string"), F.lit("/./x//y/.."))).when(turn == 1, F.concat(F.substr(path, F.lit(2)), F.lit("/")))
    walk = walk.when(turn == 2, F.concat(F.lit("../../.."), path, F.lit("/."))).otherwise(F.concat(path, F.lit("/a/b/../../c")))
    told = table(spark, sf_dir, "pages").select("page_id", paths.resolved(walk, "/srv/www").alias("path"))
    return told.groupBy("path").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n")).withColumn("shown", display_path(F.col("path"), "/srv/www"))


_ROOTS = "SELECT CASE WHEN p_partkey % 500 = 0 THEN '/' || l ELSE '/' || l || '/' || p_partkey || CASE WHEN p_partkey % 7 = 0 THEN '/' ELSE '' END END AS root FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END AS l FROM part)"


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    lang = F.when(key % 4 == 0, "/en").when(key % 4 == 1, "/de").when(key % 4 == 2, "/fr").otherwise("/es")
    root = F.when(key % 500 == 0, lang).otherwise(F.concat(lang, F.lit("/"), key.cast("string"), F.when(key % 7 == 0, "/").otherwise("")))
    return table(spark, sf_dir, "part").select(root.alias("root"))


@query(f"SELECT page_id, path, root FROM (SELECT page_id, {_PATH} AS path FROM pages) JOIN ({_ROOTS}) ON path = rtrim(root, '/') OR starts_with(path, rtrim(root, '/') || '/')")
def paths_under_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with every root that they lie below, of as many roots as there are parts."""
    return paths.under_roots(table(spark, sf_dir, "pages").select("page_id", _path().alias("path")), "path", _roots(spark, sf_dir), "root")


@query(
    f"""SELECT page_id, max_by(r, length(r)) AS root FROM (SELECT page_id, {_PATH} AS path FROM pages) JOIN (SELECT DISTINCT rtrim(root, '/') AS r FROM ({_ROOTS})) ON path = r OR starts_with(path, r || '/') GROUP BY page_id"""
)
def nearest_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.nearest_root(table(spark, sf_dir, "pages").select("page_id", _path().alias("path")), "page_id", "path", _roots(spark, sf_dir), "root")


@query(
    """WITH sources AS (SELECT DISTINCT 'notes/' || source || CASE WHEN doc_id % 3 = 0 THEN '#' || lang ELSE '' END AS source FROM documents),
    verdicts AS (SELECT doc_id, 'notes/' || source || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '#' || lang WHEN 2 THEN '#' || lang || '#' || doc_id ELSE '0' END AS spot, CASE WHEN doc_id % 5 = 0 THEN 'supported' ELSE 'missing_evidence' END AS verdict FROM documents)
    SELECT source, verdict, count(*) AS n FROM sources JOIN verdicts ON spot = source OR starts_with(spot, source || '#') GROUP BY source, verdict"""
)
def verdicts_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts counted for the source, or the part of it, that they were found in."""
    doc, lang, source = F.col("doc_id"), F.col("lang"), F.concat(F.lit("notes/"), "source")
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    sources = documents.select(F.concat(source, F.when(doc % 3 == 0, F.concat(F.lit("#"), lang)).otherwise("")).alias("source")).distinct()
    at = F.concat(source, F.when(doc % 4 == 0, "").when(doc % 4 == 1, F.concat(F.lit("#"), lang)).when(doc % 4 == 2, F.concat(F.lit("#"), lang, F.lit("#"), doc.cast("string"))).otherwise("0"))
    verdicts = documents.select(at.alias("at"), F.when(doc % 5 == 0, "supported").otherwise("missing_evidence").alias("verdict"))
    return paths.under_roots(verdicts, "at", sources, "source", "#").groupBy("source", "verdict").agg(F.count("*").alias("n"))


@query(f"SELECT route, id FROM (SELECT route, unnest(CAST(pack->'$.allowed_evidence_ids' AS VARCHAR[])) AS id FROM ({ORACLE_SQL['evidence_pack']}))")
def pack_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence ids that answers may name, read back from the packs."""
    packs = evidence_pack(spark, sf_dir).select("route", F.lit("deterministic_alignment_pack").alias("source_path"), F.col("pack").alias("excerpt"))
    other = packs.select("route", F.lit("notes.md").alias("source_path"), F.lit("no pack").alias("excerpt"))
    return answers.allowed_ids(packs.union(other), "route").select("route", F.explode("ids").alias("id"))


@query(
    """WITH d AS (SELECT doc_id, lang, source, text, CASE doc_id % 4 WHEN 0 THEN 'docs/' || lang || '_guide-' || source || '.md' WHEN 1 THEN source || '/README.md' WHEN 2 THEN 'README.md' ELSE '__.md' END AS path,
      CASE doc_id % 3 WHEN 0 THEN 'final_output_json' WHEN 1 THEN 'notes' ELSE 'Mapping_JSON' END AS stage FROM documents)
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN upper(lang[1]) || substr(lang, 2) || ' Guide ' || upper(source[1]) || substr(source, 2) WHEN 1 THEN upper(source[1]) || substr(source, 2) WHEN 2 THEN 'Readme' ELSE 'Documentation' END AS title,
      replace(left(text, 40), chr(10), ' ') AS preview, CASE lang WHEN 'de' THEN 'Deutsch' WHEN 'en' THEN 'English' ELSE 'other' END AS language,
      array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: struct_pack(i := list_position(w, x), x := x))), lambda s: s.x), ' ') AS kinds, stage LIKE '%\\_json' ESCAPE '\\' OR doc_id % 5 = 0 AS wants_json
    FROM (SELECT *, string_split(left(text, 60), ' ') AS w FROM d)"""
)
def path_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of paths, previews, labels, distinct words in their order, and whether a stage answers in JSON."""
    doc, lang, source = F.col("doc_id"), F.col("lang"), F.col("source")
    path = F.when(doc % 4 == 0, F.concat(F.lit("docs/"), lang, F.lit("_guide-"), source, F.lit(".md"))).when(doc % 4 == 1, F.concat(source, F.lit("/README.md"))).when(doc % 4 == 2, "README.md").otherwise("__.md")
    stage, prompt = F.when(doc % 3 == 0, "final_output_json").when(doc % 3 == 1, "notes").otherwise("Mapping_JSON"), F.when(doc % 5 == 0, "Please Return JSON now").otherwise("Tell")
    return table(spark, sf_dir, "documents").select(
        "doc_id", V.title_of_path(path).alias("title"), V.preview(F.col("text"), 40).alias("preview"), V.looked_up(lang, {"de": "Deutsch", "en": "English"}, "other").alias("language"),
        F.array_join(V.distinct_in_order(F.split(F.left("text", F.lit(60)), " ")), " ").alias("kinds"), V.json_stage(stage, prompt, ("_json",)).alias("wants_json"),
    )
