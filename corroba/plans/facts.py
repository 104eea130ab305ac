"""Queries over ranked entities, edges, paths, diagnostics, configuration and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroba.operators.codefacts import BUDGETS, select_facts
from corroba.operators.graph import closure
from corroba.operators.ignore import IgnoreRules
from corroba.operators.ranking import greedy_budget
from corroba.operators.verdicts import first_by
from corroba.plans.registry import query, spread_table, table

_SCORES = """SELECT p_partkey AS module, p_name AS name, CAST(4 * coalesce(a, 0) + 3 * coalesce(b, 0) + coalesce(c, 0) + CASE WHEN p_brand = 'Brand#11' THEN 8 ELSE 0 END
      - CASE WHEN p_size < 5 THEN 2 ELSE 0 END AS BIGINT) AS score, p_size < 5 AS is_test, CAST(coalesce(a, 0) AS BIGINT) AS classes, CAST(coalesce(b, 0) AS BIGINT) AS functions, CAST(coalesce(c, 0) AS BIGINT) AS imports
    FROM part LEFT JOIN (SELECT l_partkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS b, count(*) FILTER (l_returnflag = 'N') AS c
      FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey"""


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as modules: scored by counted facts, with a bonus and a malus."""
    flag = F.col("l_returnflag")
    counts = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("module"))
        .agg(F.count_if(flag == "A").alias("a"), F.count_if(flag == "R").alias("b"), F.count_if(flag == "N").alias("c"))
    )
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "module").join(counts, "module", "left").fillna(0, ["a", "b", "c"])
    score = 4 * F.col("a") + 3 * F.col("b") + F.col("c") + F.when(F.col("p_brand") == "Brand#11", 8).otherwise(0) - F.when(F.col("p_size") < 5, 2).otherwise(0)
    return part.select(
        "module", F.col("p_name").alias("name"), score.cast("long").alias("score"), (F.col("p_size") < 5).alias("is_test"), F.col("a").alias("classes"), F.col("b").alias("functions"), F.col("c").alias("imports")
    )


@query(_SCORES)
def module_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules(spark, sf_dir)


@query(f"SELECT module, name, score, is_test FROM ({_SCORES}) ORDER BY score DESC, is_test, name, module LIMIT 12")
def module_ranking_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules(spark, sf_dir).select("module", "name", "score", "is_test").orderBy(F.desc("score"), "is_test", "name", "module").limit(12)


@query(f"SELECT module, name, functions, imports FROM ({_SCORES}) ORDER BY functions DESC, imports DESC, name DESC, module DESC LIMIT 10")
def renderer_ranking_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key falls, the name included."""
    found = modules(spark, sf_dir).select("module", "name", "functions", "imports")
    return found.orderBy(F.desc("functions"), F.desc("imports"), F.desc("name"), F.desc("module")).limit(10)


_CODE = f"""modules AS (SELECT module, 'm' || module AS name, score, is_test FROM ({_SCORES})),
    symbols AS (SELECT l_partkey AS module, l_returnflag <> 'R' AS is_public, CAST(l_orderkey AS BIGINT) AS line, 's' || l_linenumber AS symbol FROM lineitem),
    imports AS (SELECT l_partkey AS module, 's' || l_suppkey AS target, l_linestatus = 'F' AS relative, count(*) AS n FROM lineitem GROUP BY ALL),
    entries AS (SELECT p_partkey AS module, 'm' || p_partkey || CASE p_size % 3 WHEN 0 THEN ':x_app' WHEN 1 THEN ':__main__' ELSE ':file' END AS label, p_brand AS path FROM part WHERE p_size > 45),
    excerpts AS (SELECT module, kind, path, line, ordinal FROM (SELECT p_partkey AS module, CASE WHEN p_size < 5 THEN 'test' ELSE 'module' END AS kind, p_brand AS path, CAST(p_size AS BIGINT) AS line,
      CAST(p_partkey AS BIGINT) AS ordinal FROM part WHERE p_size % 2 = 1))"""


def _code(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Parts as modules, line items as symbols and imports, some parts as entrypoints and excerpts."""
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    module, size = F.col("p_partkey").alias("module_name"), F.col("p_size")
    name = F.concat(F.lit("m"), F.col("p_partkey").cast("string"))
    mark = F.when(size % 3 == 0, ":x_app").when(size % 3 == 1, ":__main__").otherwise(":file")
    return [
        modules(spark, sf_dir).select(F.col("module").alias("module_name"), "score", "is_test"),
        line.select(F.col("l_partkey").alias("module_name"), (F.col("l_returnflag") != "R").alias("is_public"), F.col("l_orderkey").alias("lineno"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("symbol_name")),
        line.select(F.col("l_partkey").alias("source_module"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("imported_module"), (F.col("l_linestatus") == "F").alias("relative")).distinct(),
        part.filter(size > 45).select(module, F.concat(name, mark).alias("label"), F.col("p_brand").alias("relative_path")),
        part.filter(size % 2 == 1).select(module, F.when(size < 5, "test").otherwise("module").alias("kind"), F.col("p_brand").alias("relative_path"), size.alias("start_line"), F.col("p_partkey").alias("ordinal")),
    ]


@query(
    f"""WITH budgets(section, nm, ns, ni, ne, nx) AS (VALUES {', '.join(map(str, BUDGETS))}), {_CODE},
    starts AS (SELECT DISTINCT module FROM entries),
    chosen AS (SELECT * FROM (SELECT b.*, m.module, s.module IS NOT NULL AS starts, row_number() OVER (PARTITION BY section ORDER BY section = 'runtime_entrypoints' AND s.module IS NULL,
        is_test AND section IN ('runtime_entrypoints', 'code_structure'), score DESC, is_test, m.module) AS r
      FROM budgets AS b CROSS JOIN modules AS m LEFT JOIN starts AS s ON s.module = m.module WHERE NOT (section = 'overview' AND is_test)) WHERE r <= nm),
    shown_symbols AS (SELECT section, r, module || ':' || line || ':' || symbol AS item FROM (SELECT c.section, c.ns, x.*, row_number() OVER (PARTITION BY section ORDER BY NOT is_public, x.module, line, symbol) AS r
      FROM chosen AS c JOIN symbols AS x ON x.module = c.module) WHERE r <= ns),
    shown_imports AS (SELECT section, r, module || '>' || target AS item FROM (SELECT c.section, c.ni, x.*, row_number() OVER (PARTITION BY section ORDER BY x.module, target, relative) AS r
      FROM chosen AS c JOIN imports AS x ON x.module = c.module) WHERE r <= ni),
    kept AS (SELECT * FROM (SELECT c.section, c.ne, x.*, row_number() OVER (PARTITION BY section ORDER BY label) AS r FROM chosen AS c JOIN entries AS x ON x.module = c.module) WHERE r <= ne),
    shown_entries AS (SELECT section, row_number() OVER (PARTITION BY section ORDER BY section = 'runtime_entrypoints' AND NOT contains(label, '_app'), section = 'runtime_entrypoints' AND NOT contains(label, '__main__'),
      CASE WHEN section = 'runtime_entrypoints' THEN path END, label) AS r, label AS item FROM kept),
    shown_excerpts AS (SELECT section, r, module || ':' || line AS item FROM (SELECT c.section, c.nx, x.*, row_number() OVER (PARTITION BY section ORDER BY
        (section IN ('overview', 'architecture') AND kind = 'test') OR (section = 'runtime_entrypoints' AND NOT starts), section = 'runtime_entrypoints' AND kind = 'test',
        CASE WHEN section = 'runtime_entrypoints' THEN path END, CASE WHEN section = 'runtime_entrypoints' THEN line END, ordinal) AS r FROM chosen AS c JOIN excerpts AS x ON x.module = c.module) WHERE r <= nx)
    SELECT section, 'modules' AS kind, r AS place, CAST(module AS VARCHAR) AS item FROM chosen UNION ALL SELECT section, 'symbols', r, item FROM shown_symbols UNION ALL SELECT section, 'imports', r, item FROM shown_imports
    UNION ALL SELECT section, 'entrypoints', r, item FROM shown_entries UNION ALL SELECT section, 'excerpts', r, item FROM shown_excerpts"""
)
def section_budget_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the eight sections shows of modules, symbols, imports, entrypoints and excerpts."""
    found = select_facts(*_code(spark, sf_dir))
    text = lambda c: F.col(c).cast("string")
    items = {
        "modules": text("module_name"), "symbols": F.concat_ws(":", text("module_name"), text("lineno"), "symbol_name"), "imports": F.concat_ws(">", text("source_module"), "imported_module"),
        "entrypoints": F.col("label"), "excerpts": F.concat_ws(":", text("module_name"), text("start_line")),
    }
    out = None
    for kind, item in items.items():
        rows = found[kind].select("section", F.lit(kind).alias("kind"), F.col("place").cast("long").alias("place"), item.alias("item"))
        out = rows if out is None else out.union(rows)
    return out


@query(
    """WITH RECURSIVE scored AS (
      SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY (CASE WHEN contains(lower(left(text, 400)), 'the') THEN 5 ELSE 0 END
        + CASE WHEN contains(lower(left(text, 400)), 'la') THEN 5 ELSE 0 END) DESC, doc_id) AS r FROM documents
    ), walk AS (
      SELECT DISTINCT source, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS picked, CAST(NULL AS BIGINT) AS doc_id FROM scored
      UNION ALL
      SELECT s.source, s.r, CASE WHEN w.picked < 6 AND w.total + least(s.n, 1000) <= 4200 THEN w.total + least(s.n, 1000) ELSE w.total END,
        CASE WHEN w.picked < 6 AND w.total + least(s.n, 1000) <= 4200 THEN w.picked + 1 ELSE w.picked END,
        CASE WHEN w.picked < 6 AND w.total + least(s.n, 1000) <= 4200 THEN s.doc_id END
      FROM walk AS w JOIN scored AS s ON s.source = w.source AND s.r = w.r + 1
    ) SELECT source, doc_id, picked AS place, total FROM walk WHERE doc_id IS NOT NULL"""
)
def greedy_budget_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First fit in rank order: what is over the budget is passed by, later ones may still fit."""
    opening = F.lower(F.left("text", F.lit(400)))
    score = F.when(F.contains(opening, F.lit("the")), 5).otherwise(0) + F.when(F.contains(opening, F.lit("la")), 5).otherwise(0)
    ranked = spread_table(spark, sf_dir, "documents", "source", "doc_id", "text").select("source", "doc_id", (-score).alias("low"), F.length("text").alias("n"))
    return greedy_budget(ranked, "source", ["low", "doc_id"], "doc_id", "n", most=6, each=1000, total=4200)


_EDGES = """SELECT page_id, url AS source, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("source"), F.explode(found).alias("target"))


@query(f"SELECT page_id, source, target, NOT contains(target, '://') AS relative, count(*) AS n FROM ({_EDGES}) GROUP BY ALL")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).groupBy("page_id", "source", "target", (~F.contains("target", F.lit("://"))).alias("relative")).agg(F.count("*").alias("n"))


@query(f"SELECT page_id, target FROM ({_EDGES}) AS e WHERE page_id IN (SELECT page_id FROM pages WHERE contains(url, '://m.') OR contains(url, '/en/'))")
def edge_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "pages").filter(F.contains("url", F.lit("://m.")) | F.contains("url", F.lit("/en/"))).select("page_id")
    return links(spark, sf_dir).join(chosen, "page_id", "left_semi").select("page_id", "target")


@query(
    """WITH RECURSIVE most AS (SELECT max(p_partkey) AS n FROM part), edges AS (
      SELECT p_partkey AS parent, p_partkey * 2 AS child FROM part, most WHERE p_partkey * 2 <= n
      UNION ALL SELECT p_partkey, p_partkey * 2 + 1 FROM part, most WHERE p_partkey * 2 + 1 <= n
      UNION ALL SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey // 3 >= 1
    ), reached AS (
      SELECT child AS node FROM edges WHERE parent = 5 UNION SELECT e.child FROM reached AS r JOIN edges AS e ON e.parent = r.node
    ) SELECT r.node, array_to_string(list_sort(list_distinct(list(e.parent))), ',') AS parents FROM reached AS r
    JOIN (SELECT parent, child FROM edges WHERE parent = 5 OR parent IN (SELECT node FROM reached)) AS e ON e.child = r.node WHERE r.node <> 5 GROUP BY r.node"""
)
def transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What part 5 needs, directly or not, over a graph of all parts with cycles; each node with its parents."""
    key, most = F.col("p_partkey"), F.col("most")
    part = table(spark, sf_dir, "part").select("p_partkey")
    sized = part.join(F.broadcast(part.agg(F.max("p_partkey").alias("most"))))  # one row
    edges = sized.select(key.alias("parent"), F.explode(F.array(key * 2, key * 2 + 1, F.floor(key / 3))).alias("child"), "most").filter((F.col("child") >= 1) & (F.col("child") <= most))
    found = closure(edges.select("parent", "child"), spark.createDataFrame([(5,)], "node long"))
    return found.filter("node <> 5").select("node", F.array_join(F.array_sort("parents"), ",").alias("parents"))


PATTERNS = ("/en/", "*.html", "!/en/1*", "/de/", "!/de/2*")


@query(
    r"""WITH paths AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages),
    hits AS (SELECT page_id, path, CASE WHEN regexp_matches(path, '^/de/2[^/]*(/.*)?$') THEN 'kept' WHEN regexp_matches(path, '^/de/.*$') THEN 'ignored'
      WHEN regexp_matches(path, '^/en/1[^/]*(/.*)?$') THEN 'kept' WHEN regexp_matches(path, '(^|/)[^/]*\.html(/.*)?$') THEN 'ignored' WHEN regexp_matches(path, '^/en/.*$') THEN 'ignored' ELSE 'kept' END AS state FROM paths)
    SELECT page_id, path, state = 'ignored' AS ignored FROM hits"""
)
def ignore_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last pattern that matches a path decides; `!` takes it back."""
    paths = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"))
    return paths.withColumn("ignored", IgnoreRules(PATTERNS).matches(F.col("path"), F.lit(False)))


@query(
    r"""WITH changed AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)/', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages),
    flags AS (SELECT host, bool_or(path = 'en' OR starts_with(path, 'en/')) AS source_changed, bool_or(path = 'fr' OR starts_with(path, 'fr/')) AS reference_changed,
      bool_or((path = 'de' OR starts_with(path, 'de/')) OR contains(path, 'config')) AS docs_or_config_changed, count(*) AS n_changed FROM changed GROUP BY host)
    SELECT *, CASE WHEN docs_or_config_changed THEN 'documentation or configuration changed' WHEN source_changed AND reference_changed THEN 'source and reference changed'
      WHEN source_changed THEN 'source changed' WHEN reference_changed THEN 'reference changed' ELSE 'unrelated changes' END AS reason FROM flags"""
)
def path_prefix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corroba.operators.planning import change_plan

    changed = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)/", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1).alias("path"))
    return change_plan(changed, ["host"], source=("en",), reference=("fr",), docs=("de",), config=F.contains("path", F.lit("config")))


_RANKS = "CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END"


@query(
    f"""SELECT user_id, event_type AS layer, value FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY {_RANKS}, ts DESC, event_id DESC) AS r FROM events WHERE value IS NOT NULL) WHERE r = 1"""
)
def config_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the strongest layer that has one, the latest of it, and the layer's name."""
    rank = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 3).otherwise(4)
    given = table(spark, sf_dir, "events").filter("value IS NOT NULL").withColumn("layer", F.col("event_type"))
    return first_by(given, ["user_id"], F.struct(-rank, "ts", "event_id"), ["layer", "value"], last=True)


@query("SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY user_id, event_type")
def diag_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_seen"))


_DIAG = "SELECT event_type AS code, CASE WHEN value > 75 THEN 'error' WHEN value > 25 THEN 'warning' ELSE 'info' END AS severity, 's' || (user_id % 5) AS stage FROM events"


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("value") > 75, "error").when(F.col("value") > 25, "warning").otherwise("info")
    stage = F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("code"), severity.alias("severity"), stage.alias("stage"))


@query(f"SELECT code, severity, stage, count(*) AS n FROM ({_DIAG}) GROUP BY ALL ORDER BY n DESC, code, stage")
def diag_group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics(spark, sf_dir).groupBy("code", "severity", "stage").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code", "stage")


@query(f"SELECT code, severity, stage, count(*) AS n FROM ({_DIAG}) GROUP BY GROUPING SETS ((), (severity), (stage), (code, severity, stage))")
def diag_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diagnostics(spark, sf_dir)
    keys = [F.col("code"), F.col("severity"), F.col("stage")]
    return found.groupingSets([[], [keys[1]], [keys[2]], keys], *keys).agg(F.count("*").alias("n"))


@query(
    """WITH damaged AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN 'Notes: ' || props || ' end' WHEN 2 THEN left(props, length(props) - 1) ELSE '[1, 2]' END AS raw FROM events),
    found AS (SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) AND strpos(raw, '{') > 0 THEN regexp_extract(raw, '"k": *(-?[0-9]+)', 1) END AS k FROM damaged)
    SELECT event_id, k IS NOT NULL AND k <> '' AS recovered, coalesce(TRY_CAST(k AS BIGINT), -1) AS k FROM found"""
)
def json_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object out of answers that are whole, wrapped in prose, cut off or no object."""
    from corroba.operators.recovery import json_object

    turn, props = F.col("event_id") % 4, F.col("props")
    raw = F.when(turn == 0, props).when(turn == 1, F.concat(F.lit("Notes: "), props, F.lit(" end"))).when(turn == 2, F.expr("left(props, length(props) - 1)")).otherwise("[1, 2]")
    found = spread_table(spark, sf_dir, "events", "event_id", "props").select("event_id", json_object(raw).alias("v"))
    value = F.try_variant_get("v", "$.k", "bigint")
    return found.select("event_id", value.isNotNull().alias("recovered"), F.coalesce(value, F.lit(-1)).alias("k"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN CASE o_orderstatus WHEN 'F' THEN 'supported' ELSE 'contradicted' END ELSE 'missing_evidence' END AS status,
    o_orderstatus NOT IN ('F', 'O') AS replaced FROM orders"""
)
def status_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.broadcast(spark.createDataFrame([("F", "supported"), ("O", "contradicted")], "o_orderstatus string, status string"))
    found = table(spark, sf_dir, "orders").join(allowed, "o_orderstatus", "left")
    return found.select("o_orderkey", F.coalesce("status", F.lit("missing_evidence")).alias("status"), F.col("status").isNull().alias("replaced"))


_IDS = r"list_distinct(regexp_extract_all(lower('see ' || event_type || ':' || user_id || ' and nation:' || (event_id % 30)), '[a-z_]+:[a-z0-9_./-]+'))"


@query(
    f"""WITH known AS (SELECT list('nation:' || n_nationkey) AS ids FROM nation),
    notes AS (SELECT event_id, {_IDS} AS ids FROM events)
    SELECT event_id, array_to_string(list_sort(list_filter(n.ids, lambda x: list_contains(k.ids, x))), ',') AS kept, array_to_string(list_sort(list_filter(n.ids, lambda x: NOT list_contains(k.ids, x))), ',') AS dropped
    FROM notes AS n CROSS JOIN known AS k"""
)
def id_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corroba.operators.recovery import split_ids

    known = table(spark, sf_dir, "nation").agg(F.collect_set(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string"))).alias("known"))
    note = F.concat(F.lit("see "), F.col("event_type"), F.lit(":"), F.col("user_id").cast("string"), F.lit(" and nation:"), (F.col("event_id") % 30).cast("string"))
    notes = table(spark, sf_dir, "events").select("event_id", note.alias("note")).join(F.broadcast(known))
    kept, dropped = split_ids(F.col("note"), F.col("known"))
    return notes.select("event_id", F.array_join(kept, ",").alias("kept"), F.array_join(dropped, ",").alias("dropped"))


@query(
    """WITH missing AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type = 'view'),
    unknown AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type = 'click')
    SELECT m.user_id, m.event_id, u.value FROM missing AS m JOIN unknown AS u USING (user_id, r)"""
)
def zip_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th missing heading of a user takes the n-th content that no heading claimed."""
    events = table(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    missing = events.filter("event_type = 'view'").select("user_id", "event_id", place.alias("r"))
    unknown = events.filter("event_type = 'click'").select("user_id", "value", place.alias("r"))
    return missing.join(unknown, ["user_id", "r"]).select("user_id", "event_id", "value")


@query(
    """SELECT quality_class, lang, count(*) AS n, count(*) FILTER (toxic = 1) AS n_flagged FROM (
      SELECT lang, toxic, CASE WHEN signals = 0 THEN 'missing' WHEN signals > 1 THEN 'multiple' WHEN quality = 1 THEN 'expression' WHEN long THEN 'field' ELSE 'classifier' END AS quality_class
      FROM (SELECT d.lang, l.toxic, l.quality, d.n_chars > 3000 AS long, CAST(coalesce(l.quality, 0) = 1 AS INT) + CAST(d.n_chars > 3000 AS INT) + CAST(d.source = 'src0' AS INT) AS signals
        FROM documents AS d LEFT JOIN labels AS l USING (doc_id))) GROUP BY ALL"""
)
def license_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corroba.operators.inventory import quality_class

    found = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    signals = {"expression": F.coalesce(F.col("quality"), F.lit(0)) == 1, "field": F.col("n_chars") > 3000, "classifier": F.col("source") == "src0"}
    return found.groupBy(quality_class(signals).alias("quality_class"), "lang").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("n_flagged"))


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS installed, coalesce(CAST(l.quality AS VARCHAR), 'not installed') AS version FROM documents AS d LEFT JOIN labels AS l USING (doc_id)")
def inventory_left_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("version"))
    found = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return found.select("doc_id", F.col("version").isNotNull().alias("installed"), F.coalesce("version", F.lit("not installed")).alias("version"))


@query(
    """SELECT d.doc_id, CASE WHEN d.source IN ('src1', 'src2') THEN 'not_ingestible' WHEN p.doc_id IS NOT NULL THEN 'parsed' WHEN u.doc_id IS NOT NULL THEN 'ingestible_unparsed' ELSE 'not_attempted' END AS parse_status
    FROM documents AS d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 0) AS p USING (doc_id) LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) AS u USING (doc_id)"""
)
def parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed and unparsed are two sets of paths; one join tells both."""
    from corroba.operators.inventory import parse_state

    tried = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 0).alias("parsed"))
    found = table(spark, sf_dir, "documents").select("doc_id", "source").join(tried, "doc_id", "left")
    return found.select("doc_id", parse_state(~F.col("source").isin("src1", "src2"), F.col("parsed")).alias("parse_status"))


@query(
    f"""SELECT f.user_id, f.first_id, l.last_type FROM
    (SELECT user_id, event_id AS first_id, row_number() OVER (PARTITION BY user_id ORDER BY {_RANKS}, event_id) AS r FROM events) AS f
    JOIN (SELECT user_id, event_type AS last_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) AS l ON l.user_id = f.user_id AND l.r = 1 WHERE f.r = 1"""
)
def first_last_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 3).otherwise(4)
    first, last = F.min(F.struct(rank.alias("rank"), F.col("event_id").alias("event_id"))), F.max_by("event_type", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(first.alias("f"), last.alias("last_type")).select("user_id", F.col("f.event_id").alias("first_id"), "last_type")


@query(
    """WITH c AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0), o AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F')
    SELECT 'union' AS op, id FROM (SELECT id FROM c UNION SELECT id FROM o) UNION ALL SELECT 'intersect', id FROM (SELECT id FROM c INTERSECT SELECT id FROM o)
    UNION ALL SELECT 'except', id FROM (SELECT id FROM c EXCEPT SELECT id FROM o)"""
)
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which side has an id is told once; the three results are read off it."""
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.lit(1).alias("side"))
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), F.lit(2).alias("side"))
    sides = c.union(o).groupBy("id").agg(F.bool_or(F.col("side") == 1).alias("c"), F.bool_or(F.col("side") == 2).alias("o"))
    ops = F.array_compact(F.array(F.lit("union"), F.when(F.col("c") & F.col("o"), "intersect"), F.when(F.col("c") & ~F.col("o"), "except")))
    return sides.select(F.explode(ops).alias("op"), "id")


@query(
    """SELECT priority, '# ' || priority || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY status) || chr(10) AS page FROM (
      SELECT priority, status, '- `' || status || '`: ' || n AS line FROM (SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL)) GROUP BY priority"""
)
def render_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corroba.operators.rendering import page

    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    line = F.concat(F.lit("- `"), F.col("status"), F.lit("`: "), F.col("n").cast("string"))
    return page(counts.select("priority", "status", line.alias("line")), "priority", "status", "line")


@query(
    """WITH o AS (SELECT user_id, min(CASE WHEN event_type = 'view' THEN ts END) AS token_at, min(CASE WHEN event_type = 'click' THEN ts END) AS failed_at, count(*) AS attempts FROM events GROUP BY user_id)
    SELECT user_id, attempts, CASE WHEN failed_at IS NULL THEN 'completed' WHEN token_at IS NULL THEN 'exhausted' WHEN failed_at < token_at THEN 'retried' ELSE 'interrupted' END AS outcome FROM o"""
)
def stream_retry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures before the first token are tried again, those after it interrupt."""
    token, failed = F.min(F.when(F.col("event_type") == "view", F.col("ts"))), F.min(F.when(F.col("event_type") == "click", F.col("ts")))
    found = table(spark, sf_dir, "events").groupBy("user_id").agg(token.alias("token"), failed.alias("failed"), F.count("*").alias("attempts"))
    outcome = F.when(F.col("failed").isNull(), "completed").when(F.col("token").isNull(), "exhausted").when(F.col("failed") < F.col("token"), "retried").otherwise("interrupted")
    return found.select("user_id", "attempts", outcome.alias("outcome"))


@query("SELECT CAST(i AS BIGINT) AS attempt, CAST(least(5 * pow(2, i), 60) AS BIGINT) AS seconds FROM range(0, 5) AS r(i)")
def retry_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corroba.operators.planning import timeout_ladder

    return spark.range(1).select(F.posexplode(timeout_ladder(5, 60)).alias("at", "s")).select(F.col("at").cast("long").alias("attempt"), F.col("s").cast("long").alias("seconds"))


@query("SELECT n_name AS field, n_regionkey = 0 AS has_alias, lower(n_name) || '->' || r_name AS mapping FROM nation JOIN region ON n_regionkey = r_regionkey")
def registry_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue's fields, a row for each of their aliases."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    catalogue = nation.groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    found = catalogue.select(F.explode("names").alias("field"), "n_regionkey", "r_name")
    return found.select("field", (F.col("n_regionkey") == 0).alias("has_alias"), F.concat(F.lower("field"), F.lit("->"), F.col("r_name")).alias("mapping"))


@query("SELECT bool_or(o_orderstatus = 'F') AS source_changed, bool_or(o_totalprice < 0) AS reference_changed, bool_or(o_orderpriority = '5-LOW') AS docs_or_config_changed, count(*) AS n_changed FROM orders")
def change_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(
        F.bool_or(F.col("o_orderstatus") == "F").alias("source_changed"),
        F.bool_or(F.col("o_totalprice") < 0).alias("reference_changed"),
        F.bool_or(F.col("o_orderpriority") == "5-LOW").alias("docs_or_config_changed"),
        F.count("*").alias("n_changed"),
    )

