"""Many patterns in one pass, what sections take of chunks, and their prompts."""

import random

import pytest
from pyspark.sql import functions as F

from corroba.operators import prompts as P
from corroba.operators.patterns import occurrences, with_hits

CHUNKS = "path string, chunk_index long, chunk_id string, text string, section_hint string"
ROWS = [
    ("README.md", 0, "README.md:0:a", "Intro and definitions.", "Intro"),
    ("README.md", 1, "README.md:1:b", "Architecture interpretation and component boundaries.", "Architecture"),
    ("README.md", 2, "README.md:2:c", "Theory assumptions and mismatch handling.", "Theory-Alignment"),
    ("a.md", 0, "a.md:0:d", "Nothing of it.", None),
]


@pytest.mark.parametrize("shard_bytes", [1 << 20, 60])
def test_occurrences_against_looking_for_each(spark, shard_bytes):
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abä漢") for _ in range(n))
    texts = [(i, letters(rng.randrange(40))) for i in range(60)] + [(60, None), (61, "")]
    patterns = [(k, letters(rng.randrange(5))) for k in range(40)] + [(40, None), (41, ""), (42, "ab"), (43, "ab")]
    rows, asked = spark.createDataFrame(texts, "id int, t string").repartition(3), spark.createDataFrame(patterns, "k int, p string")
    found = occurrences(rows, "id", F.col("t"), asked, "k", "p", shard_bytes)
    want = sorted((i, k) for i, t in texts for k, p in patterns if t is not None and p is not None and p in t)
    assert sorted(tuple(r) for r in found.collect()) == want and found.columns == ["id", "k"]
    assert occurrences(rows, "id", F.col("t"), asked.limit(0), "k", "p").count() == 0
    assert occurrences(rows.limit(0), "id", F.col("t"), asked, "k", "p").count() == 0


def test_hits_stand_beside_the_row(spark):
    rows = spark.createDataFrame([(1, "he she", 5), (2, None, 6)], "id int, row string, hits int").withColumnRenamed("hits", "other")
    assert [tuple(r) for r in with_hits(rows, F.col("row"), ["she", "he", "", "x"]).collect()] == [(1, "he she", 5, [0, 1, 2]), (2, None, 6, [])]
    assert [r.hits for r in with_hits(rows, F.col("row"), []).collect()] == [[], []]


def test_relevance_by_hand(spark):
    found = {(r.section, r.chunk_id[-1]): r.score for r in P.relevance(spark.createDataFrame(ROWS, CHUNKS)).collect()}
    assert len(found) == 8 * len(ROWS)
    # two keywords (one of them the path's), and the keyword and name that stand in the hint
    assert found["overview", "a"] == 10 and found["architecture", "b"] == 5 * 2 + 6
    assert found["theory_alignment", "c"] == 5 * 4 + 6 and found["architecture", "d"] == 0


def test_keywords_beyond_the_opening_do_not_count(spark):
    rows = [("x", 0, "x0", "y" * 398 + "main", None), ("x", 1, "x1", "y" * 396 + "main", None), (None, None, None, None, None)]
    found = P.relevance(spark.createDataFrame(rows, CHUNKS)).filter("section = 'runtime_entrypoints'").collect()
    assert sorted((r.chunk_id or "", r.score) for r in found) == [("", 0), ("x0", 0), ("x1", 5)]


def greedy(rows, section):
    def score(r):
        looked_at = " ".join([r[0].lower(), (r[4] or "").lower(), r[3][:400].lower()])
        return sum(5 for k in section.keywords if k in looked_at) + (6 if section.name in (r[4] or "").lower().replace("-", "_") else 0)

    spent, out = 0, []
    for r in sorted(rows, key=lambda r: (-score(r), r[:3])):
        n = min(len(r[3]), section.each)
        if len(out) < section.most and spent + n <= section.total:
            spent += n
            out.append((section.name, len(out) + 1, spent, r[2]))
    return out


def test_selection_against_the_ordered_walk(spark):
    rng = random.Random(5)
    words = [w for s in P.SECTIONS for w in s.keywords] + ["other"] * 40
    rows = [(f"p{rng.randrange(6)}", i, f"c{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 300))), rng.choice([None, "Code Structure", "code-structure"])) for i in range(150)]
    found = P.selected(spark.createDataFrame(rows, CHUNKS).repartition(4)).select("section", "place", "total", "chunk_id").collect()
    assert sorted(tuple(r) for r in found) == sorted(x for s in P.SECTIONS for x in greedy(rows, s))


def test_what_is_gathered_does_not_grow_with_a_key(spark):
    """Of 20,000 rows of one key and three lengths, six a length are picked from."""
    from corroba.operators.ranking import greedy_budget

    rows = spark.range(20_000).selectExpr("'k' AS k", "id AS o", "id AS v", "100 + id % 3 AS n")
    found = greedy_budget(rows, "k", ["o"], "v", "n", most=6, each=1000, total=10_000)
    assert [r.v for r in found.orderBy("place").collect()] == [0, 1, 2, 3, 4, 5]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def tables(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    code = {k: empty("section string, place int, line string") for k in ("modules", "symbols")}
    return dict(
        facts=empty("place int, line string"), evidence=empty("section string, place int, category string, path string, line_count int, excerpt string"), sources=empty("path string, extension string, size_bytes long"),
        code=code, materials=empty("route string, ordinal int, source_path string, section_hint string, excerpt string"),
    )


def test_prompts_of_nothing_say_so(spark):
    found = {r.section: r.prompt for r in P.prompts(spark.createDataFrame([], CHUNKS), **tables(spark)).collect()}
    assert set(found) == {s.name for s in P.SECTIONS}
    for s in P.SECTIONS:
        text = found[s.name]
        assert text.startswith(f"[TASK {s.name}]") and all(f"- {h}" in text for h in s.headings) and all(x in text for x in s.focus)
        assert "No evidence was found." in text and "No references were found." in text and "[MODULES: 0]\n- None" in text
        assert "CHUNKS" not in text and "MATERIAL" not in text and "\n\n\n" not in text


def test_prompts_show_what_budgets_allow(spark):
    given = tables(spark)
    route = "readme_claim_alignment"
    given["materials"] = spark.createDataFrame([(route, i, f"m{i}", None, f"line {i}\n\n[FACTS") for i in range(13)] + [("elsewhere", 1, "m", None, "lost")], given["materials"].schema)
    given["sources"] = spark.createDataFrame([(f"s{i:03}.md", ".md", i) for i in range(P.LISTED + 3)], given["sources"].schema)
    given["code"]["modules"] = spark.createDataFrame([("overview", 2, "- b"), ("overview", 1, "- a")], given["code"]["modules"].schema)
    given["facts"] = spark.createDataFrame([(2, "second"), (1, "first")], given["facts"].schema)
    long = [("z.md", 7, "z.md:7:e", "readme claim " * 200, "h")]
    found = {r.section: r.prompt for r in P.prompts(spark.createDataFrame(ROWS + long, CHUNKS), **given).collect()}
    readme = found[route]
    assert f"[MATERIAL OF {route}: 10]" in readme and "source: m9" in readme and "source: m10" not in readme and "lost" not in readme
    assert "MATERIAL" not in found["overview"] and "[MODULES: 2]\n- a\n- b" in found["overview"] and "[MODULES: 0]" in found["architecture"]
    assert "- and 3 more" in readme and "s199.md (.md, 199 bytes)" in readme and "s200.md" not in readme
    assert "[FACTS OF THE SCAN]\nfirst\nsecond" in readme
    assert ("readme claim " * 200)[:900] in readme and ("readme claim " * 200)[:901] not in readme
    order = ["[TASK", "[FACTS", "[EVIDENCE", "[REFERENCES]", "[MODULES", "[SYMBOLS", "[ANSWER]", "[REFERENCE CHUNKS", "[MATERIAL"]
    at = [readme.index(x) for x in order]
    assert at == sorted(at)


def test_tasks_rank_few_rows_whatever_the_tables_size(spark, tmp_path, monkeypatch):
    """What a task sorts: a bounded number of chunks, modules and evidence before they are repeated for
    sections, imports of shown modules only, and no materials."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from corroba.operators import spread
    from corroba.operators.codefacts import select_facts
    from corroba.operators.rendering import authoritative

    monkeypatch.setattr(spread, "ROWS", 100)
    n = 4_000
    pq.write_table(pa.table({"path": ["a.md"] * n, "chunk_index": list(range(n)), "chunk_id": [str(i) for i in range(n)], "text": [f"overview {i}" for i in range(n)], "section_hint": [None] * n}, pa.schema([("path", "string"), ("chunk_index", "int64"), ("chunk_id", "string"), ("text", "string"), ("section_hint", "string")])), tmp_path / "c.parquet")
    chunks = spark.read.parquet(str(tmp_path / "c.parquet"))
    ranked = P.relevance(chunks, scanned=True)
    assert max(r["count"] for r in ranked.groupBy(F.spark_partition_id()).count().collect()) <= 2 * 100 * len(P.SECTIONS)
    assert ranked.exceptAll(P.relevance(chunks)).count() == 0 and ranked.count() == n * len(P.SECTIONS)

    def plan(rows):
        return rows._jdf.queryExecution().optimizedPlan().toString()

    def depth(text, mark):
        return min(len(line) - len(line.lstrip(" :+-")) for line in text.splitlines() if mark in line)

    materials = spark.createDataFrame([("general_reference_alignment", i, "p", None, f"t{i}") for i in range(30)], "route string, ordinal int, source_path string, section_hint string, excerpt string")
    first = P.material_lines(materials, P.SECTIONS)
    assert [(r.section, r.a, r.line[-2:]) for r in first.orderBy("a").limit(2).collect()] == [("reference_alignment", 1, "t0"), ("reference_alignment", 2, "t1")] and first.count() == P.MATERIALS
    assert "GlobalLimit" in plan(first)
    assert P.material_lines(materials, tuple(s for s in P.SECTIONS if not s.route)).count() == 0
    evidence = spark.range(100).selectExpr("CAST(id AS STRING) AS path", "CASE id % 3 WHEN 0 THEN 'docs' WHEN 1 THEN 'test_file' ELSE 'package_config' END AS category")
    text = plan(authoritative(evidence, ("overview", "architecture")))
    assert depth(text, "WindowGroupLimit [category") > depth(text, "Join Inner") > depth(text, "WindowGroupLimit [section")
    empty = {"symbols": "module_name string, is_public boolean, lineno long, symbol_name string", "entrypoints": "module_name string, label string, relative_path string", "excerpts": "module_name string, kind string, relative_path string, start_line int, ordinal int"}
    empty = {k: spark.createDataFrame([], v) for k, v in empty.items()}
    modules = spark.range(50).selectExpr("CAST(id AS STRING) AS module_name", "id AS score", "id % 2 = 0 AS is_test")
    imports = spark.range(200).selectExpr("CAST(id % 50 AS STRING) AS source_module", "CAST(id % 7 AS STRING) AS imported_module", "false AS relative").distinct()
    text = plan(select_facts(modules, empty["symbols"], imports, empty["entrypoints"], empty["excerpts"])["imports"])
    assert depth(text, "Join LeftSemi") > depth(text, "Aggregate [source_module")
