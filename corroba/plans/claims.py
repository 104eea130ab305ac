"""Queries that match claims with evidence and bring them to verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.operators.containment import first_holding, holding
from corroba.operators.verdicts import RULES, first_by, judge, verdict
from corroba.plans.registry import query, table

_RULES = "(VALUES " + ", ".join(f"('{m}', {str(h).lower()}, '{p}', '{r}', '{t}')" for m, h, p, r, t in RULES) + ") AS rules(matcher, hit, polarity, result, tier)"


@query(
    """WITH hits AS (
      SELECT DISTINCT d.doc_id, b.item_id FROM documents AS d JOIN benchmark AS b ON contains(d.text, b.text)
    ), docs AS (
      SELECT d.doc_id, d.lang, count(h.item_id) AS supported, CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END AS contradicted, l.doc_id IS NULL AS unlabelled
      FROM documents AS d LEFT JOIN hits AS h USING (doc_id) LEFT JOIN labels AS l USING (doc_id) GROUP BY ALL
    ), verdicts AS (
      SELECT lang, CASE WHEN contradicted = 1 THEN 'contradicted' WHEN supported > 0 AND NOT unlabelled THEN 'supported'
        WHEN supported > 0 THEN 'partially_supported' ELSE 'missing_evidence' END AS verdict FROM docs
    ) SELECT lang, verdict, count(*) AS n FROM verdicts GROUP BY lang, verdict"""
)
def claim_verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as claims: benchmark passages in them support, toxic labels contradict, and
    documents without a label stay partly unresolved; verdicts by language."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    hits = holding(documents, "doc_id", "text", items, "item_id", "passage").groupBy("doc_id").agg(F.count("*").alias("hits"))
    claims = documents.select("doc_id", "lang").join(hits, "doc_id", "left").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    told = verdict(
        F.lit("general"), F.lit(True), F.coalesce(F.col("toxic") == 1, F.lit(False)), F.coalesce(F.col("hits") > 0, F.lit(False)), F.col("toxic").isNull()
    )
    return claims.groupBy("lang", told.alias("verdict")).agg(F.count("*").alias("n"))


_EVIDENCE = """SELECT kind, value, id FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal, value) AS r FROM (
        SELECT kind, value, lower(replace(kind || ':' || value, ' ', '_')) AS id, ordinal FROM (
          SELECT 'nation' AS kind, n_name AS value, n_nationkey AS ordinal FROM nation
          UNION ALL SELECT 'region', r_name, 100000 + r_regionkey FROM region
          UNION ALL SELECT 'brand', p_brand, 200000 + p_partkey FROM part
          UNION ALL SELECT 'brand', upper(p_brand), 900000000 + p_partkey FROM part))) WHERE r = 1"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region, part = (table(spark, sf_dir, t) for t in ("nation", "region", "part"))
    every = (
        nation.select(F.lit("nation").alias("kind"), F.col("n_name").alias("value"), F.col("n_nationkey").cast("long").alias("ordinal"))
        .unionByName(region.select(F.lit("region").alias("kind"), F.col("r_name").alias("value"), (F.lit(100000) + F.col("r_regionkey")).cast("long").alias("ordinal")))
        .unionByName(part.select(F.lit("brand").alias("kind"), F.col("p_brand").alias("value"), (F.lit(200000) + F.col("p_partkey")).alias("ordinal")))
        .unionByName(part.select(F.lit("brand").alias("kind"), F.upper("p_brand").alias("value"), (F.lit(900000000) + F.col("p_partkey")).alias("ordinal")))
    )
    named = every.withColumn("id", F.lower(F.replace(F.concat_ws(":", "kind", "value"), F.lit(" "), F.lit("_"))))
    return first_by(named, ["id"], F.struct("ordinal", "value"), ["kind", "value"])


@query(_EVIDENCE)
def evidence_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).select("kind", "value", "id")


@query(
    f"""WITH atoms AS (
      SELECT o_orderstatus AS object, CASE WHEN contains(o_orderpriority, 'LOW') THEN 'negative' ELSE 'positive' END AS polarity, 'exists_closed' AS matcher FROM orders
      UNION ALL SELECT o_orderstatus, CASE WHEN contains(o_orderpriority, 'LOW') THEN 'negative' ELSE 'positive' END, 'exists_open' FROM orders
    ), matched AS (SELECT a.*, a.object IN ('F', 'O') AS hit FROM atoms AS a)
    SELECT m.matcher, m.object, m.polarity, r.result, r.tier, count(*) AS n FROM matched AS m JOIN {_RULES.replace('AS rules', 'AS r')}
    ON r.matcher = m.matcher AND r.hit = m.hit AND r.polarity = m.polarity GROUP BY ALL"""
)
def match_exists_closed_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    known = spark.createDataFrame([("F",), ("O",)], "object string").withColumn("known", F.lit(True))
    polarity = F.when(F.contains("o_orderpriority", F.lit("LOW")), "negative").otherwise("positive")
    # atoms that are alike are counted before they are matched
    atoms = orders.groupBy(F.col("o_orderstatus").alias("object"), polarity.alias("polarity")).agg(F.count("*").alias("n"))
    atoms = atoms.withColumn("matcher", F.explode(F.array(F.lit("exists_closed"), F.lit("exists_open"))))
    matched = atoms.join(F.broadcast(known), "object", "left").withColumn("hit", F.coalesce("known", F.lit(False)))
    return judge(matched).select("matcher", "object", "polarity", "result", "tier", "n")


@query(
    f"""WITH registry AS (SELECT lower(n_name) AS alias, lower(r_name) AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey),
    atoms AS (
      SELECT lower(n_name) AS alias, lower(r_name) AS canonical, CASE WHEN n_nationkey % 2 = 0 THEN 'positive' ELSE 'negative' END AS polarity FROM nation CROSS JOIN region
    ), matched AS (SELECT a.*, g.alias IS NOT NULL AS hit FROM atoms AS a LEFT JOIN registry AS g ON g.alias = a.alias AND g.canonical = a.canonical)
    SELECT m.alias, m.canonical, m.polarity, r.matcher, r.result, r.tier FROM matched AS m JOIN {_RULES.replace('AS rules', 'AS r')} ON r.hit = m.hit AND r.polarity = m.polarity
    WHERE r.matcher IN ('alias_maps', 'alias_first_path')"""
)
def match_alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence carries its alias and canonical name in a map, as atoms name them; every nation is
    tried with every region's name (25 and 5 rows)."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    metadata = F.create_map(F.lit("alias"), F.lower("n_name"), F.lit("canonical"), F.lower("r_name"))
    known = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(metadata.alias("m"))
    known = known.select(F.col("m")["alias"].alias("alias"), F.col("m")["canonical"].alias("canonical"), F.lit(True).alias("known"))
    names = region.agg(F.collect_set(F.lower("r_name")).alias("names"))
    atoms = nation.join(F.broadcast(names)).select(
        F.lower("n_name").alias("alias"), F.explode("names").alias("canonical"), F.when(F.col("n_nationkey") % 2 == 0, "positive").otherwise("negative").alias("polarity")
    )
    matched = atoms.join(F.broadcast(known), ["alias", "canonical"], "left").withColumn("hit", F.coalesce("known", F.lit(False)))
    both = matched.withColumn("matcher", F.explode(F.array(F.lit("alias_maps"), F.lit("alias_first_path"))))
    return judge(both).select("alias", "canonical", "polarity", "matcher", "result", "tier")


@query(
    r"""WITH anchors AS (
      SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 4)[1:6]) AS token FROM benchmark
    ), hits AS (SELECT DISTINCT a.item_id, d.doc_id FROM anchors AS a JOIN documents AS d ON contains(lower(d.text), a.token))
    SELECT item_id, doc_id, rank FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM hits) WHERE rank <= 6"""
)
def match_lexical_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six documents that hold an anchor token of an item."""
    tokens = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)), lambda x: F.length(x) >= 4)
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.slice(tokens, 1, 6)).alias("anchor"))
    return first_holding(table(spark, sf_dir, "documents"), "doc_id", F.split(F.lower("text"), "[^a-z0-9_]+"), items, "item_id", "anchor", most=6)


@query("SELECT doc_id, item_id FROM documents AS d JOIN benchmark AS b ON contains(d.text, b.text)")
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holding(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark").withColumnRenamed("text", "passage"), "item_id", "passage")


@query("SELECT o_orderstatus AS route, o_orderpriority AS verdict, count(*) AS n FROM orders GROUP BY ALL")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("route"), F.col("o_orderpriority").alias("verdict")).agg(F.count("*").alias("n"))


@query(
    """SELECT o_custkey AS source, count(*) FILTER (o_orderstatus = 'F') AS n_supported, count(*) FILTER (o_orderstatus = 'O') AS n_missing,
    count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS n_other FROM orders GROUP BY o_custkey"""
)
def verdicts_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("source"))
        .agg(F.count_if(status == "F").alias("n_supported"), F.count_if(status == "O").alias("n_missing"), F.count_if(~status.isin("F", "O")).alias("n_other"))
    )


_FLAGS = """SELECT l_orderkey, CASE l_orderkey % 3 WHEN 0 THEN 'agent' WHEN 1 THEN 'readme' ELSE 'general' END AS route, l_orderkey % 5 <> 0 AS verifiable,
      bool_or(l_returnflag = 'R' AND l_linestatus = 'F') AS c, bool_or(l_returnflag = 'A') AS s, bool_or(l_returnflag = 'N') AS u FROM lineitem GROUP BY l_orderkey"""


@query(
    f"""SELECT l_orderkey, route, CASE WHEN route = 'agent' AND NOT verifiable THEN 'out_of_scope_or_non_verifiable' WHEN route = 'readme' AND NOT verifiable THEN 'not_statically_verifiable'
      WHEN c THEN 'contradicted' WHEN s AND NOT u THEN 'supported' WHEN s AND u THEN 'partially_supported' WHEN route = 'general' THEN 'missing_evidence' ELSE 'not_evidenced' END AS verdict
    FROM ({_FLAGS})"""
)
def verdict_truth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    claims = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.bool_or((flag == "R") & (F.col("l_linestatus") == "F")).alias("c"), F.bool_or(flag == "A").alias("s"), F.bool_or(flag == "N").alias("u"))
    )
    turn = F.col("l_orderkey") % 3
    route = F.when(turn == 0, "agent").when(turn == 1, "readme").otherwise("general")
    return claims.select("l_orderkey", route.alias("route"), verdict(route, F.col("l_orderkey") % 5 != 0, F.col("c"), F.col("s"), F.col("u")).alias("verdict"))


@query(
    """SELECT l_orderkey, coalesce(string_agg(DISTINCT 'supplier:' || l_suppkey, ',' ORDER BY 'supplier:' || l_suppkey) FILTER (l_returnflag <> 'R'), '') AS supporting,
    coalesce(string_agg(DISTINCT 'supplier:' || l_suppkey, ',' ORDER BY 'supplier:' || l_suppkey) FILTER (l_returnflag = 'R'), '') AS contradicting FROM lineitem GROUP BY l_orderkey"""
)
def support_id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string"))

    def joined(holds):
        return F.array_join(F.array_sort(F.collect_set(F.when(holds, name))), ",")

    returned = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(joined(~returned).alias("supporting"), joined(returned).alias("contradicting"))


@query(
    """SELECT l_orderkey, string_agg(note, '; ' ORDER BY r) AS notes FROM (
      SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus || ':' || l_partkey AS note, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag || l_linestatus) AS r FROM lineitem)
    WHERE r <= 8 GROUP BY l_orderkey"""
)
def ordered_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.concat(F.col("l_returnflag"), F.col("l_linestatus"), F.lit(":"), F.col("l_partkey").cast("string"))
    fragments = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", note.alias("note"))))
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.slice(fragments, 1, 8).alias("f"))
    return found.select("l_orderkey", F.array_join(F.transform("f", lambda x: x["note"]), "; ").alias("notes"))
