"""From a tree to its pages, and what a second run makes."""

import pytest
from pyspark.sql import functions as F

from corroba.engine import Engine
from corroba.operators import prompts
from corroba.operators.stages import Store, content_digest
from corroba.plans.sources import SOURCES


def write(root, files):
    for path, text in files.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)


@pytest.fixture
def tree(tmp_path):
    write(tmp_path / "tree", {**SOURCES, "README.md": "# Shop\n\n- Run corroba ground\n- It is fast\n", "AGENTS.md": "Keep a friendly tone.\n", "pyproject.toml": "[project]\nname = 'x'", "docs/guide.md": "# Guide\n\n" + "word " * 60})
    return tmp_path


def cheap(spark):
    """A page a section, of the number of the tree's modules."""
    return lambda section, tables: tables["modules"].agg(F.concat(F.lit(f"# {section.title}\n\nmanaged page of "), F.count("*").cast("string"), F.lit(" modules\n")).alias("page"))


def test_a_run_and_a_second_one(spark, tree):
    engine, target, store = Engine(spark, str(tree / "tree")), tree / "pages", str(tree / "store")
    first = dict(engine.run(str(target), store, page=cheap(spark)))
    assert set(first.values()) == {"made"} and len(first) == 12 + len(prompts.SECTIONS) and engine.snapshot is None
    assert {p.name for p in target.glob("*.md")} == {f"{s.name}.md" for s in prompts.SECTIONS} | {"README.md"}
    before = {p.name: p.read_text() for p in target.glob("*.md")}
    assert set(dict(engine.run(str(target), store, page=cheap(spark))).values()) == {"kept"}
    assert {p.name: p.read_text() for p in target.glob("*.md")} == before
    (tree / "tree/docs/new.md").write_text("more")
    assert set(dict(engine.run(str(target), store, page=cheap(spark))).values()) == {"made"}


def test_after_a_failure_only_what_is_missing_is_made(spark, tree):
    engine, target, store = Engine(spark, str(tree / "tree")), tree / "pages", str(tree / "store")
    whole = cheap(spark)

    def failing(section, tables):
        if section.name in ("architecture", "overview"):
            return tables["modules"].select(F.raise_error(F.lit("out of luck")).alias("page"))
        return whole(section, tables)

    told = dict(engine.run(str(target), store, page=failing))
    assert {k for k, v in told.items() if v.startswith("failed")} == {"page-architecture", "page-overview"}
    assert "could not be made" in (target / "overview.md").read_text() and "managed page of" in (target / "code_structure.md").read_text()
    again = dict(engine.run(str(target), store, page=whole))
    assert {k for k, v in again.items() if v == "made"} == {"page-architecture", "page-overview"}
    assert "managed page of 4 modules" in (target / "overview.md").read_text()


def test_a_run_fails_if_all_sections_do(spark, tree):
    engine, target = Engine(spark, str(tree / "tree")), tree / "pages"

    def failing(section, tables):
        raise OSError("no")

    with pytest.raises(RuntimeError, match="no section could be made: OSError"):
        engine.run(str(target), str(tree / "store"), page=failing)
    assert not target.exists()


def test_pages_of_facts(spark, tree):
    engine = Engine(spark, str(tree / "tree"))
    wanted = tuple(s for s in prompts.SECTIONS if s.name in ("overview", "readme_claim_alignment"))
    tables = {**engine.code(), "manifest": engine.scan(), "evidence": engine.evidence(), "references": engine.discover(), "claims": engine.evaluate()}
    overview, claims = (engine.section_page(s, tables).first().page for s in wanted)
    assert overview.startswith("# Overview\n\n<!-- managed page -->\n\n## Repository\n\n- top level directories: docs, src, tests\n")
    assert "## Modules\n\n- shop.cli\n" in overview and "- README.md (parsed)" in overview and "## Claims" not in overview and "\n\n\n" not in overview
    assert "## Claims\n\n- not_statically_verifiable: 1\n- supported: 1\n- Run corroba ground (supported)\n- It is fast (not_statically_verifiable)\n" in claims


def test_outputs_are_known_by_settings_and_reads(spark, tmp_path):
    made = []

    def make(n):
        return lambda: made.append(n) or spark.range(n)

    store = Store(spark, str(tmp_path))
    one = store.stage("a", make(3))
    assert store.stage("a", make(4)).rows.count() == 3 and made == [3]
    assert store.stage("a", make(5), settings={"x": 1}).rows.count() == 5
    assert store.stage("b", make(6), (one,)).rows.count() == 6 and store.stage("b", make(7), ("other",)).made
    path = next(p for p in tmp_path.glob("a-*") if (p / "_SUCCESS").exists())
    (path / "_SUCCESS").unlink()  # as if the job had not committed
    store.stage("a", make(3)), store.stage("a", make(5), settings={"x": 1})
    assert len(made) == 5


def test_content_digests_do_not_depend_on_order(spark):
    rows = spark.range(100).selectExpr("id", "cast(id % 7 AS string) AS s")
    assert content_digest(rows) == content_digest(rows.orderBy(F.desc("id")).select("s", "id").repartition(5))
    assert len({content_digest(x) for x in (rows, rows.union(rows.limit(1)), rows.limit(0), rows.withColumn("s", F.lit("1")))}) == 4
