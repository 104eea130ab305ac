from corroba.engine import Engine
from corroba.operators.chunking import ChunkSizes
from corroba.operators.codefacts import code_tables
from corroba.plans.sources import SOURCES, files_of, small_docx
from corroba.sources.files import changed_files, decoded, decoded_or_null, described, flattened, ingest, markdown_blocks, read_toml
from corroba.streaming.chunks import run_chunk_stream


def test_code_facts(spark):
    found = code_tables(files_of(spark, SOURCES))
    modules = {r.module_name: r for r in found["modules"].collect()}
    assert set(modules) == {"shop", "shop.cart", "shop.cli", "tests.test_cart"}
    assert modules["shop.cli"].module_importance_score == 3 + 1 + 8
    signatures = {r.symbol_name: r.signature for r in found["symbols"].collect()}
    assert signatures["_total"] == "_total(cart, /, *items, tax, **more) -> int"
    assert signatures["serve"] == "async serve(name, *, port) -> None" and signatures["Cart"] == "class Cart"
    assert {(r.source_module, r.imported_module, r.relative) for r in found["imports"].collect()} >= {("shop", ".cart.*", True), ("shop.cart", ".money", True), ("shop.cart", "time", False)}
    assert {r.label for r in found["entrypoints"].collect()} == {"shop.cli:filename_hint", "shop.cli:__main__", "shop.cli:typer_app:app"}
    assert {r.module_name: (r.start_line, r.end_line) for r in found["excerpts"].collect()}["shop.cart"] == (5, 11)
    assert [r.hint for r in found["framework_hints"].collect()] == ["typer"]


def test_ingest(spark):
    files = files_of(spark, {"a.md": "#\nx", "b.txt": "\n first\n", "e.txt": "", "c.docx": small_docx("T", "B"), "bad.docx": b"x", "bad.pdf": b"x", "f.rst": "x"})
    documents, unparsed = ingest(files)
    assert {r.path: r.title for r in documents.collect()} == {"a.md": "a", "b.txt": "first", "e.txt": "e", "c.docx": "T"}
    assert {r.path for r in unparsed.collect()} == {"bad.docx", "bad.pdf"}


def test_decoding(spark):
    files = described(spark.createDataFrame([("a", bytearray(b"a\xffb"))], "path string, content binary"))
    row = files.select(decoded().alias("d"), decoded_or_null().alias("n")).first()
    assert row.d == "a�b" and row.n is None


def test_markdown_blocks(spark):
    files = files_of(spark, {"a.md": "intro\n\n# One\nx\ny\n\nz\n#\nw", "b.txt": "p\n\nq"})
    got = [(r.path, r.block_index, r.text, r.section_hint) for r in markdown_blocks(ingest(files)[0]).orderBy("path", "block_index").collect()]
    assert got == [("a.md", 0, "intro", None), ("a.md", 1, "x\ny", "One"), ("a.md", 2, "z", "One"), ("a.md", 3, "w", "One"), ("b.txt", 0, "p", None), ("b.txt", 1, "q", None)]


def test_engine_over_a_tree(spark, tmp_path):
    for path, text in {**SOURCES, "docs/guide.md": "# Guide\n\n" + "word " * 60, "build/out.md": "no", "README.md": "# R", "pyproject.toml": "[project]\nname = 'x'"}.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    engine = Engine(spark, str(tmp_path), sizes=ChunkSizes(20, 40, 60))
    top = engine.scan().first()
    assert top.top_level_directories == ["docs", "src", "tests"] and top.has_pyproject and not top.has_git_dir
    assert {r.category for r in engine.evidence().collect()} == {"readme", "runtime_config", "test"}
    assert engine.code()["modules"].count() == 4
    chunks = engine.ground().filter("path = 'docs/guide.md'").collect()
    assert chunks[0].section_hint == "Guide" and chunks[0].chunk_id.startswith("meth:docs/guide.md:0:")
    assert engine.plan() is None or engine.plan().count() == 1
    assert changed_files(str(tmp_path / "none")) is None


def test_configuration_files(tmp_path):
    (tmp_path / "a.toml").write_text("[a]\nb = [1, 2]\n[a.c]\nd = 'x'")
    assert flattened(read_toml(str(tmp_path / "a.toml"))) == [("a.b", "1,2"), ("a.c.d", "x")]
    assert read_toml(str(tmp_path / "none.toml")) == {}


def test_chunks_from_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc_id long, text string")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows.write.parquet(source)
    run_chunk_stream(spark, source, rows.schema, target, str(tmp_path / "state")).awaitTermination()
    assert {(r.doc_id, r.text) for r in spark.read.parquet(target).collect()} == {(1, "a\n\nb"), (2, "c")}
    rows.limit(1).write.mode("append").parquet(source)
    run_chunk_stream(spark, source, rows.schema, target, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(target).count() == 3


def test_engine_judges_claims(spark, tmp_path):
    files = {
        **SOURCES,
        "README.md": "# Shop\n\n- Run corroba ground and render-all\n- It is fast\n\n## Use\n\n- The entrypoint shop.cli:filename_hint starts it\n- `overview.md` is not written\n",
        "AGENTS.md": "Keep a friendly tone.\nreference_paths is a config field, please.\n",
        "notes/a.md": "source_dir maps to the reference_paths, but never reference_dir maps to reference_paths.\n",
        "notes/b.rst": "no document",
    }
    for path, text in files.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    engine = Engine(spark, str(tmp_path))
    found = {r.path: (r.route, r.parse_status) for r in engine.discover(("notes",)).collect()}
    assert found == {
        "README.md": ("readme_claim_alignment", "parsed"), "AGENTS.md": ("agent_instruction_alignment", "parsed"), "notes/a.md": ("general_reference_alignment", "parsed"),
        "notes/b.rst": ("general_reference_alignment", "not_ingestible"),
    }
    got = {(r.path, r.ordinal): (r.section, r.verdict, r.supporting) for r in engine.evaluate(explicit=("notes",)).collect()}
    assert got[("README.md", 0)] == ("Shop", "contradicted", ["cli_subcommand:ground"])
    assert got[("README.md", 1)][:2] == ("Shop", "not_statically_verifiable")
    assert got[("README.md", 2)] == ("Use", "supported", ["entrypoint:shop.cli:filename_hint"])
    assert got[("README.md", 3)][:2] == ("Use", "contradicted")
    assert got[("AGENTS.md", 0)][1] == "out_of_scope_or_non_verifiable" and got[("AGENTS.md", 1)][1] == "partially_supported"
    assert got[("notes/a.md", 0)][1] == "contradicted"
    assert engine.code_summary().first().modules == 4
    assert {r.section for r in engine.sections()["modules"].collect()} >= {"overview", "code_structure"}


def test_an_empty_change_list_has_a_reason(spark):
    from pyspark.sql import functions as F

    from corroba.operators.planning import change_plan, place_of_reference, plan_text

    none = spark.createDataFrame([], "path string")
    row = plan_text(change_plan(none, [], ("src",), ("ref",), ("docs",), F.lit(False))).first()
    assert row.reason == "nothing changed" and not row.source_changed and row.text.startswith("Update plan\nchanged files: 0")
    places = spark.createDataFrame([("/r/a", True), ("/r/a.md", False), ("/rest", False)], "p string, d boolean")
    assert [r[0] for r in places.select(place_of_reference(F.col("p"), "/r", F.col("d"))).collect()] == ["directory", "file", "outside"]


def test_settings_as_rows(spark, tmp_path):
    import pytest

    from corroba.sources import settings

    rows = settings.environment(spark, {"a": ("NEW_A", "OLD_A"), "b": ("B",), "c": ("C",)}, {"OLD_A": "1", "NEW_A": "", "B": "2"}).collect()
    assert [tuple(r) for r in rows] == [("a", "OLD_A", "1"), ("b", "B", "2")]
    packages = {r.name: r for r in settings.installed_packages(spark, ["pyspark", "no-such-package"]).collect()}
    assert packages["pyspark"].version and packages["no-such-package"].version is None
    assert [r.command for r in settings.commands(spark, ["b", "a", "b", ""]).collect()] == ["a", "b"]
    pytest.importorskip("yaml")
    (tmp_path / "a.yml").write_text("nav: [a.md]")
    (tmp_path / "b.yml").write_text("")
    (tmp_path / "c.yml").write_text("- x")
    assert settings.read_yaml(str(tmp_path / "a.yml")) == {"nav": ["a.md"]} and settings.read_yaml(str(tmp_path / "b.yml")) == {}
    with pytest.raises(ValueError):
        settings.read_yaml(str(tmp_path / "c.yml"))


def test_pages_as_files(spark, tmp_path):
    from corroba.operators.reports import write_pages

    pages = spark.createDataFrame([("a.md", "x"), ("b/c.md", "é"), ("d.md", None)], "path string, page string")
    assert {r.path: r.bytes for r in write_pages(pages, f"file://{tmp_path}").collect()} == {"a.md": 1, "b/c.md": 2, "d.md": 0}
    assert (tmp_path / "b/c.md").read_text() == "é"


def test_dependencies_of_a_tree(spark, tmp_path):
    from corroba.operators.inventory import failures

    (tmp_path / "pyproject.toml").write_text(
        "[build-system]\nrequires = ['no-such-builder>=1']\n[project]\nname = 'x'\ndependencies = ['pandas>=1', 'Pandas>=1', 'pandas>=1']\n[project.optional-dependencies]\ntest = ['pytest; python_version > \"3\"']\n"
    )
    rows = {(r.name, r.requirement): r for r in Engine(spark, str(tmp_path)).dependencies().collect()}
    assert {k for k, r in rows.items() if r.direct} == {("pandas", "pandas>=1"), ("pandas", "Pandas>=1"), ("pytest", 'pytest; python_version > "3"'), ("no-such-builder", "no-such-builder>=1")}
    assert rows[("pandas", "pandas>=1")].installed and not rows[("no-such-builder", "no-such-builder>=1")].installed
    assert rows[("numpy", "")].source == "transitive" and "pandas" in rows[("numpy", "")].parents.split(",")
    assert rows[("no-such-builder", "no-such-builder>=1")].summary == "missing"
    told = spark.createDataFrame([("a", True, False, "missing"), ("b", False, False, "classifier_only"), ("c", True, True, "missing")], "name string, direct boolean, installed boolean, quality string")
    assert {r.condition: r.packages for r in failures(told).collect()} == {"not-installed": "a", "missing-license": "a, c", "classifier-only": "b"}
