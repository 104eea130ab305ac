"""Queries of caps by route, checks, run summaries, navigation and pages to write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.operators import reports as R
from corroba.plans.answers import _answers, _expected, _u
from corroba.plans.registry import query, table


@query("SELECT route, id, place FROM (SELECT o_orderstatus AS route, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 10")
def route_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("route"), F.col("o_orderkey").alias("id"), (-F.col("o_totalprice")).alias("low"))
    return R.capped(rows, "route", ["low", "id"]).select("route", "id", F.col("place").cast("long").alias("place"))


@query(
    """SELECT conv_id, string_agg(left(text, 80), chr(10) || chr(10) ORDER BY turn, text) AS material FROM (
      SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r FROM conversations WHERE text IS NOT NULL) WHERE r <= 4 GROUP BY conv_id"""
)
def chunk_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").withColumn("o", F.struct("turn", "text"))
    return R.chunk_material(turns, "conv_id", "o", "text", 4, 80)


@query(
    """SELECT s_suppkey, "check", level FROM (
      SELECT s_suppkey, 'balance' AS "check", CASE WHEN s_acctbal > 0 THEN 'pass' WHEN s_acctbal > -500 THEN 'warn' ELSE 'fail' END AS level FROM supplier
      UNION ALL SELECT s_suppkey, 'name', CASE WHEN s_name LIKE 'Supplier%' THEN 'pass' ELSE 'fail' END FROM supplier UNION ALL SELECT s_suppkey, 'nation', CASE WHEN s_nationkey < 20 THEN 'pass' ELSE 'warn' END FROM supplier)"""
)
def required_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance, nation = F.col("s_acctbal"), F.col("s_nationkey")
    rules = {"balance": (balance > 0, balance > -500), "name": (F.col("s_name").startswith("Supplier"), F.lit(False)), "nation": (nation < 20, F.lit(True))}
    return R.checks(table(spark, sf_dir, "supplier"), rules).select("s_suppkey", "check", "level")


@query(
    """SELECT (SELECT count(*) FROM documents) AS discovered, (SELECT count(*) FROM labels WHERE toxic = 0) AS parsed, (SELECT count(*) FROM labels WHERE toxic = 1) AS unparsed,
    (SELECT count(*) FROM part) AS modules, (SELECT count(*) FROM lineitem) AS symbols, (SELECT count(DISTINCT conv_id) FROM conversations) AS claims"""
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [
        table(spark, sf_dir, "documents").agg(F.count("*").alias("discovered")),
        table(spark, sf_dir, "labels").agg(F.count_if(F.col("toxic") == 0).alias("parsed"), F.count_if(F.col("toxic") == 1).alias("unparsed")),
        table(spark, sf_dir, "part").agg(F.count("*").alias("modules")),
        table(spark, sf_dir, "lineitem").agg(F.count("*").alias("symbols")),
        table(spark, sf_dir, "conversations").agg(F.count_distinct("conv_id").alias("claims")),
    ]
    out = counts[0]
    for one in counts[1:]:
        out = out.join(one)  # one row each
    return out


@query(
    """SELECT 'p' || p_partkey AS path, p_name AS page FROM part LEFT JOIN (SELECT p_partkey AS k, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'x managed page' ELSE 'authored' END AS old FROM part WHERE p_size > 10) ON k = p_partkey
    WHERE k IS NULL OR old <> 'authored'"""
)
def pages_to_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    path, turn = F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size") % 4
    old = F.when(turn == 0, "").when(turn == 1, "x managed page").otherwise("authored")
    return R.to_write(part.select(path, F.col("p_name").alias("page")), part.filter("p_size > 10").select(path, old.alias("page")))


NAVS = (
    '["index.md", {"Guide {u}": "guide/{u}.md"}, {"More": ["a.md", {"B": "b.MD"}, "index.md", {"Deep": [{"C": "c{u}.md"}]}]}, 5, "https://x"]',
    '{"Only": "one{u}.md"}',
    '"alone.md"',
    "[]",
)


@query(
    _expected(
        len(NAVS), "place, label, target",
        [
            (0, 0, None, "index.md"), (0, 1, "Guide {u}", "guide/{u}.md"), (0, 2, None, "a.md"), (0, 3, "B", "b.MD"), (0, 4, "C", "c{u}.md"), (1, 0, "Only", "one{u}.md"), (2, 0, None, "alone.md"),
        ],
        f"place, {_u('label')}, {_u('target')}",
    )
)
def navigation_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = _answers(spark, sf_dir, NAVS).select("event_id", F.try_parse_json("raw").alias("nav"))
    return R.navigation(trees, "event_id", "nav")
