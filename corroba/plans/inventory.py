"""Queries over reference materials and dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.operators import discovery, inventory
from corroba.operators.rendering import page
from corroba.plans.registry import query, table

_FILES = r"""SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) || '/' || CASE page_id % 7 WHEN 0 THEN 'README.md' WHEN 1 THEN 'sub/AGENTS.md' WHEN 2 THEN page_id || '.txt' WHEN 3 THEN page_id || '.rst'
    WHEN 4 THEN 'a/b/Codex.MD' WHEN 5 THEN page_id || '/README.md' ELSE page_id || '.md' END AS path FROM pages"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of a tree whose directories are languages."""
    key = F.col("page_id").cast("string")
    turn = F.col("page_id") % 7
    name = (
        F.when(turn == 0, "README.md").when(turn == 1, "sub/AGENTS.md").when(turn == 2, F.concat(key, F.lit(".txt"))).when(turn == 3, F.concat(key, F.lit(".rst")))
        .when(turn == 4, "a/b/Codex.MD").when(turn == 5, F.concat(key, F.lit("/README.md"))).otherwise(F.concat(key, F.lit(".md")))
    )
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]*)", 1), F.lit("/"), name).alias("path"))


_FOUND = rf"""WITH files AS (SELECT DISTINCT path FROM ({_FILES})),
    named AS (SELECT *, upper(regexp_extract(path, '([^/]*)$', 1)) AS name, lower(regexp_extract(path, '[^/.][^/]*(\.[^./]+)$', 1)) AS extension FROM files),
    found AS (SELECT path, extension, CASE WHEN path = 'en' OR starts_with(path, 'en/') OR path = 'de/README.md' THEN 'explicit' WHEN regexp_matches(path, '^[^/]*/README\.md$') THEN 'readme' WHEN regexp_matches(path, '(^|/)AGENTS\.md$') THEN 'agent' END AS how,
      CASE WHEN name = 'README.MD' THEN 'readme' WHEN name IN ('AGENTS.MD', 'CODEX.MD') THEN 'agent' ELSE 'general' END AS by_name FROM named),
    kinds AS (SELECT *, CASE WHEN how = 'explicit' THEN by_name ELSE how END AS which FROM found WHERE how IS NOT NULL),
    materials AS (SELECT path, extension, CASE WHEN how = 'explicit' THEN 'explicit' ELSE 'default' END AS origin, CASE which WHEN 'readme' THEN 'readme_claims' WHEN 'agent' THEN 'agent_instruction' ELSE 'general_reference' END AS kind,
      CASE which WHEN 'readme' THEN 'readme_claim_alignment' WHEN 'agent' THEN 'agent_instruction_alignment' ELSE 'general_reference_alignment' END AS route,
      CASE how WHEN 'explicit' THEN 'explicit input' WHEN 'readme' THEN 'default README target (pattern=*/README.md)' ELSE 'default agent instruction target (pattern=**/AGENTS.md)' END AS reason,
      extension IN ('.md', '.txt', '.pdf', '.docx') AS eligible FROM kinds)"""


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select("path").distinct()
    return discovery.discover(files, ("en", "de/README.md"), ("*/README.md",), ("**/AGENTS.md", "**/CODEX.md"))


@query(f"{_FOUND} SELECT * FROM materials")
def reference_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materials(spark, sf_dir)


@query(
    f"""{_FOUND}, tried AS (SELECT path, bool_or(page_id % 2 = 0) AS ok FROM ({_FILES}) WHERE page_id % 3 <> 0 GROUP BY path)
    SELECT path, CASE WHEN NOT eligible THEN 'not_ingestible' WHEN ok THEN 'parsed' WHEN ok IS NOT NULL OR route = 'general_reference_alignment' THEN 'ingestible_unparsed' ELSE 'not_attempted' END AS parse_status,
      eligible AND route = 'general_reference_alignment' AS grounds FROM materials LEFT JOIN tried USING (path)"""
)
def reference_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materials(spark, sf_dir)
    tried = _files(spark, sf_dir).filter("page_id % 3 <> 0")
    even = F.col("page_id") % 2 == 0
    told = discovery.with_status(found, tried.filter(even), tried.filter(~even))
    grounds = discovery.grounding(found).select("path", F.lit(True).alias("g"))
    return told.join(grounds, "path", "left").select("path", "parse_status", F.coalesce("g", F.lit(False)).alias("grounds"))


_PACKAGES = """WITH RECURSIVE most AS (SELECT max(p_partkey) AS n FROM part),
    declared AS (SELECT p_partkey AS k, 'pkg-' || p_partkey AS name, CASE p_size WHEN 1 THEN 'runtime' WHEN 2 THEN 'dev:test' ELSE 'build-system' END AS source, 'Pkg_' || p_partkey || '>=1; extra' AS requirement FROM part WHERE p_size <= 3),
    installed AS (SELECT p_partkey AS k, 'pkg-' || p_partkey AS name, CASE WHEN p_size % 4 = 0 THEN p_type ELSE '' END AS expression, CASE WHEN p_size % 6 = 0 THEN p_brand ELSE '' END AS field,
      CASE WHEN p_size % 5 = 0 THEN ['OSI', p_brand] ELSE [] END AS classifiers FROM part WHERE p_partkey % 5 <> 0),
    edges AS (SELECT k AS parent, c AS child FROM (SELECT k, unnest([k * 2, k * 2 + 1]) AS c FROM installed), most WHERE c <= n),
    reached AS (SELECT e.child AS k FROM edges AS e WHERE parent IN (SELECT k FROM declared) UNION SELECT e.child FROM reached AS r JOIN edges AS e ON e.parent = r.k),
    parents AS (SELECT child AS k, array_to_string(list_sort(list_distinct(list('pkg-' || parent))), ',') AS parents FROM edges WHERE parent IN (SELECT k FROM reached) OR parent IN (SELECT k FROM declared) GROUP BY child),
    named AS (SELECT name, source, requirement, true AS direct, '' AS parents FROM declared
      UNION ALL SELECT 'pkg-' || k, 'transitive', '', false, parents FROM reached JOIN parents USING (k) WHERE k NOT IN (SELECT k FROM declared)),
    signals AS (SELECT n.*, i.name IS NOT NULL AS installed, coalesce(i.expression, '') AS e, coalesce(i.field, '') AS f, coalesce(i.classifiers, []) AS c FROM named AS n LEFT JOIN installed AS i USING (name)),
    rows AS (SELECT *, CASE WHEN e = '' AND f = '' AND len(c) = 0 THEN 'missing' WHEN CAST(e <> '' AS INT) + CAST(f <> '' AS INT) + CAST(len(c) > 0 AS INT) > 1 THEN 'multiple_signals'
      WHEN e <> '' THEN 'license_expression' WHEN f <> '' THEN 'license_field_only' ELSE 'classifier_only' END AS quality FROM signals),
    told AS (SELECT name, source, requirement, direct, parents, installed, quality, CASE WHEN quality = 'missing' THEN 'missing' ELSE quality || ': ' || array_to_string(list_filter([CASE WHEN e <> '' THEN 'expr=' || e END,
      CASE WHEN f <> '' THEN 'license=' || f END, CASE WHEN len(c) > 0 THEN 'classifiers=' || array_to_string(c, '; ') END], lambda x: x IS NOT NULL), ' | ') END AS summary FROM rows)"""


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as packages: small ones are declared, four of five installed, each needs two others."""
    part = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    name = lambda k: F.concat(F.lit("pkg-"), k.cast("string"))
    requirement = F.concat(F.lit("Pkg_"), key.cast("string"), F.lit(">=1; extra"))
    source = F.when(size == 1, "runtime").when(size == 2, "dev:test").otherwise("build-system")
    direct = part.filter(size <= 3).select(inventory.requirement_name(requirement).alias("name"), source.alias("source"), requirement.alias("requirement")).dropDuplicates(["name", "source", "requirement"])
    classifiers = F.when(size % 5 == 0, F.array(F.lit("OSI"), F.col("p_brand"))).otherwise(F.array().cast("array<string>"))
    installed = part.filter(key % 5 != 0).select(
        name(key).alias("name"), F.when(size % 4 == 0, F.col("p_type")).otherwise("").alias("e"), F.when(size % 6 == 0, F.col("p_brand")).otherwise("").alias("f"), classifiers.alias("c")
    )
    most = part.agg(F.max("p_partkey").alias("most"))  # one row
    needs = part.join(F.broadcast(most)).select(name(key).alias("name"), F.explode(F.array(key * 2, key * 2 + 1)).alias("k"), "most").filter("k <= most").select("name", name(F.col("k")).alias("needs"))
    more = inventory.transitive(direct, installed, needs)
    rows = direct.select("name", "source", "requirement", F.lit(True).alias("direct"), F.lit("").alias("parents")).union(more.select("name", F.lit("transitive"), F.lit(""), F.lit(False), "parents"))
    found = rows.join(installed, "name", "left").withColumn("installed", F.col("e").isNotNull()).fillna("", ["e", "f"]).withColumn("c", F.coalesce("c", F.array().cast("array<string>")))
    signals = {"license_expression": F.col("e") != "", "license_field_only": F.col("f") != "", "classifier_only": F.size("c") > 0}
    quality = inventory.quality_class(signals)
    quality = F.when(quality == "multiple", "multiple_signals").otherwise(quality)
    told = found.withColumn("quality", quality).withColumn("summary", inventory.license_summary(F.col("e"), F.col("f"), F.col("c"), F.col("quality")))
    return told.select("name", "source", "requirement", "direct", "parents", "installed", "quality", "summary")


@query(f"{_PACKAGES} SELECT * FROM told")
def dependency_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages(spark, sf_dir)


@query(
    f"""{_PACKAGES} SELECT condition, string_agg(name, ', ' ORDER BY name) AS packages FROM (
      SELECT 'not-installed' AS condition, name FROM told WHERE direct AND NOT installed UNION ALL SELECT 'missing-license', name FROM told WHERE quality = 'missing'
      UNION ALL SELECT 'classifier-only', name FROM told WHERE quality = 'classifier_only') GROUP BY condition"""
)
def dependency_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.failures(packages(spark, sf_dir))


@query(
    f"""{_PACKAGES}, lines AS (SELECT source, name, '| `' || name || '`' || CASE WHEN requirement <> '' THEN ' (`' || requirement || '`)' ELSE '' END || CASE WHEN parents <> '' THEN ' (parents: `' || replace(parents, ',', ', ') || '`)' ELSE '' END
      || ' | ' || CASE WHEN installed THEN 'installed' ELSE 'not-installed' END || ' | ' || summary || ' |' AS line FROM told)
    SELECT source, '# ' || source || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY name) || chr(10) AS page FROM lines GROUP BY source"""
)
def dependency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown page for each source of packages."""
    rows = packages(spark, sf_dir)
    required = F.when(F.col("requirement") != "", F.concat(F.lit(" (`"), F.col("requirement"), F.lit("`)"))).otherwise("")
    needed = F.when(F.col("parents") != "", F.concat(F.lit(" (parents: `"), F.replace("parents", F.lit(","), F.lit(", ")), F.lit("`)"))).otherwise("")
    state = F.when(F.col("installed"), "installed").otherwise("not-installed")
    line = F.concat(F.lit("| `"), F.col("name"), F.lit("`"), required, needed, F.lit(" | "), state, F.lit(" | "), F.col("summary"), F.lit(" |"))
    return page(rows.withColumn("line", line), "source", "name", "line")


@query(
    f"""{_PACKAGES} SELECT name, source || ',' || name || ',' || installed || ',' || quality AS csv, '{{"name":"' || name || '","source":"' || source || '","installed":' || installed || ',"quality":"' || quality || '"}}' AS json FROM told"""
)
def dependency_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the CSV and of the JSON report."""
    lines = inventory.csv_lines(packages(spark, sf_dir), ["source", "name", "installed", "quality"])
    return lines.select("name", F.col("line").alias("csv"), F.to_json(F.struct("name", "source", "installed", "quality")).alias("json"))
