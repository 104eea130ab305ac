"""Resolved paths and the roots above them."""

import os
import random

from pyspark.sql import functions as F

from corroba.operators import paths


def test_resolved_as_the_system_does(spark):
    rng = random.Random(2)
    given = ["/".join(rng.choice(["", ".", "..", "a", "b.c", "é"]) for _ in range(rng.randrange(1, 9))) for _ in range(200)] + ["", "/", "//", "..", "/..", None]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(given)], "i int, p string")
    for base in ("/", "/srv/w", "/srv/w/"):
        found = {r.i: r.p for r in rows.select("i", paths.resolved("p", base).alias("p")).collect()}
        for i, p in enumerate(given):
            want = None if p is None else os.path.normpath(p if p.startswith("/") else f"{base.rstrip('/')}/{p}")
            assert found[i] == (want and "/" + want.lstrip("/")), p


def test_roots_above_paths_against_looking_at_each(spark):
    rng = random.Random(3)
    steps = lambda n: "/".join(rng.choice("abc") for _ in range(n))
    given = [(i, rng.choice(["", "/"]) + steps(rng.randrange(6))) for i in range(80)] + [(100, None), (101, "a//b"), (102, "ab/c")]
    known = [rng.choice(["", "/"]) + steps(rng.randrange(1, 4)) + rng.choice(["", "/"]) for _ in range(30)] + [None, "", "a/"]
    rows, roots = spark.createDataFrame(given, "id int, p string"), spark.createDataFrame([(r,) for r in known], "r string")
    above = lambda p, r: p is not None and r is not None and r.rstrip("/") != "" and (p == r.rstrip("/") or p.startswith(r.rstrip("/") + "/"))
    found = sorted((r.id, r.r) for r in paths.under_roots(rows, "p", roots, "r").collect())
    assert found == sorted((i, r) for i, p in given for r in known if above(p, r))
    deepest = {r.id: r.r for r in paths.nearest_root(rows, "id", "p", roots, "r").collect()}
    assert deepest == {i: max((r.rstrip("/") for r in known if above(p, r)), key=len) for i, p in given if any(above(p, r) for r in known)}
    assert paths.under_roots(rows, "p", roots.limit(0), "r").count() == 0


def test_many_roots_without_a_nested_loop(spark, sf_dir):
    roots = spark.range(10_000).selectExpr("concat('/en/', id) AS root")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"))
    found = paths.under_roots(pages, "path", roots, "root")
    assert found.count() == pages.filter(r"path RLIKE '^/en/[0-9]{1,4}(/|$)'").count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_parts_of_a_source(spark):
    rows = spark.createDataFrame([("a#b#c",), ("a",), ("ab#c",)], "at string")
    roots = spark.createDataFrame([("a",), ("a#b",)], "source string")
    assert sorted(tuple(r) for r in paths.under_roots(rows, "at", roots, "source", "#").collect()) == [("a", "a"), ("a#b#c", "a"), ("a#b#c", "a#b")]


def test_explicit_references_elsewhere(spark, tmp_path):
    from corroba.engine import Engine

    for path, text in {"tree/README.md": "# R", "tree/notes/a.md": "a", "tree/notes/b.rst": "b", "elsewhere/c.md": "c", "elsewhere/deep/AGENTS.md": "d", "one.txt": "e"}.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    engine = Engine(spark, str(tmp_path / "tree"))
    found = {r.path: (r.origin, r.route, r.parse_status) for r in engine.discover(("notes/../notes", f"{tmp_path}/elsewhere", "../one.txt", "./notes/a.md", "none")).collect()}
    general = "general_reference_alignment"
    assert found == {
        "README.md": ("default", "readme_claim_alignment", "parsed"), "notes/a.md": ("explicit", general, "parsed"), "notes/b.rst": ("explicit", general, "not_ingestible"),
        f"{tmp_path}/elsewhere/c.md": ("explicit", general, "parsed"), f"{tmp_path}/elsewhere/deep/AGENTS.md": ("explicit", "agent_instruction_alignment", "parsed"), f"{tmp_path}/one.txt": ("explicit", general, "parsed"),
    }
