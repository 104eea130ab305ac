"""A facade over the operators: from a tree of files to facts, chunks and plans."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.functions import text as T
from corroba.functions.values import MANAGED
from corroba.operators import atoms, discovery, inventory, prompts, rendering
from corroba.operators.chunking import ChunkSizes, chunk_id, chunks_of
from corroba.operators.claims import classify, segment_line, segments
from corroba.operators.codefacts import BUDGETS, code_tables, select_facts, summary
from corroba.operators.ignore import DEFAULT_PATTERNS, IgnoreRules, prune, stack
from corroba.operators.planning import CONFIG_FILES, change_plan
from corroba.operators.stages import Store, content_digest
from corroba.sources import files as sources
from corroba.sources import pages, settings


class Engine:
    def __init__(self, spark: SparkSession, root: str, ignored: tuple[str, ...] = (), unignored: tuple[str, ...] = (), sizes: ChunkSizes = ChunkSizes()):
        self.spark, self.root, self.sizes = spark, root, sizes
        self.rules = IgnoreRules(stack(DEFAULT_PATTERNS, ignored, unignore=unignored))
        #: The files as a run has them, so that all its stages see the same tree.
        self.snapshot: DataFrame | None = None

    def files(self, ignore: bool = True) -> DataFrame:
        if self.snapshot is not None:
            return prune(self.snapshot, self.rules) if ignore else self.snapshot
        return sources.scan(self.spark, self.root, self.rules if ignore else None)

    def scan(self) -> DataFrame:
        return sources.manifest(self.files())

    def evidence(self) -> DataFrame:
        return sources.textual_evidence(self.files(ignore=False))

    def code(self) -> dict[str, DataFrame]:
        return code_tables(self.files())

    def documents(self) -> tuple[DataFrame, DataFrame]:
        """(documents, unparsed)"""
        return sources.ingest(self.files())

    def ground(self) -> DataFrame:
        """The documents' chunks with ids, section hints and sizes."""
        blocks = sources.markdown_blocks(self.documents()[0])
        chunks = chunks_of(blocks, "path", "block_index", "text", F.col("section_hint"), self.sizes)
        return chunks.withColumn("chunk_id", chunk_id(F.col("path"), F.col("chunk_index"), F.col("text"))).withColumn("char_count", F.length("text"))

    def discover(self, explicit: tuple[str, ...] = ()) -> DataFrame:
        """Reference materials, explicit ones and the usual README and instruction files, with what became of each.
        Explicit paths may have `.` and `..` and may lie outside the root, where they go by their whole path."""
        files, inside = self._with_references(explicit)
        documents, unparsed = sources.ingest(files)
        return discovery.with_status(discovery.discover(files, inside), documents, unparsed)

    def _with_references(self, explicit: tuple[str, ...]) -> tuple[DataFrame, tuple[str, ...]]:
        """(the tree's files and those of explicit paths outside it, the explicit paths as files has them)"""
        files, root = self.files(ignore=False), posixpath.normpath(re.sub("^file:/*", "/", self.root))
        asked = []
        for path in sorted({posixpath.normpath(posixpath.join(root, p)) for p in explicit}):
            if path == root:
                asked += [r.path for r in files.filter("depth = 0").select("path").collect()] + [r.path for r in files.filter("depth > 0").select(F.substring_index("path", "/", 1).alias("path")).distinct().collect()]
            elif path.startswith(f"{root}/"):
                asked.append(path.removeprefix(f"{root}/"))
            else:
                folder, name = posixpath.split(path)
                found = sources.scan(self.spark, path) if sources.is_folder(path) else sources.scan(self.spark, folder, names=f"^{re.escape(name)}$")
                base = path if sources.is_folder(path) else folder
                files = files.unionByName(sources.described(found.select(F.concat(F.lit(f"{base}/"), "path").alias("path"), "content")))
                asked.append(path)
        return files, tuple(asked)

    def code_summary(self) -> DataFrame:
        return summary(self.code())

    def sections(self) -> dict[str, DataFrame]:
        """What of the code facts each section shows."""
        code = self.code()
        modules = code["modules"].select("module_name", F.col("module_importance_score").alias("score"), F.col("is_test_module").alias("is_test"))
        return select_facts(modules, code["symbols"], code["imports"], code["entrypoints"], code["excerpts"])

    def evaluate(self, registry: atoms.Registry = atoms.Registry(), explicit: tuple[str, ...] = ()) -> DataFrame:
        """path, ordinal, section, route, claim, verdict and evidence ids of every claim in the reference
        materials, held against the registry, the code facts and the textual evidence."""
        files, explicit = self._with_references(explicit)
        routes = F.create_map(*(F.lit(x) for name, (_, route) in discovery.KINDS.items() for x in (route, name)))
        texts = discovery.discover(files, explicit).filter("eligible").select("path", routes[F.col("route")].alias("route"))
        texts = texts.join(sources.ingest(files)[0].select("path", F.col("raw_text").alias("text")), "path")
        claims = segments(texts).withColumn("claim", T.clean(segment_line(F.col("line")))).filter("claim <> ''").drop("line")
        # the normal form is a column of its own, so that it is made once
        claims = claims.withColumn("normal", T.norm("claim")).withColumn("verifiable", classify(F.col("route"), F.col("normal"))["verifiable"]).drop("normal")
        manifest = self.files(ignore=False).filter("depth = 0").select("path")
        evidence = atoms.evidence_of(self.spark, registry, self.code(), manifest, self.evidence())
        keys = ["path", "ordinal"]
        judged = atoms.match(atoms.atomise(claims, registry), evidence, [*keys, "atom_index"])
        return claims.join(atoms.verdicts(judged, keys, "route", "verifiable"), keys)

    def dependencies(self) -> DataFrame:
        """The packages that the tree's pyproject.toml declares and what they need, as installed here."""
        declared = inventory.declared(sources.read_toml(f"{self.root}/pyproject.toml"))
        direct = self.spark.createDataFrame(declared, "source string, requirement string")
        return inventory.dependencies(direct, settings.installed_packages(self.spark))

    def plan(self, source: tuple[str, ...] = ("src",), reference: tuple[str, ...] = (), docs: tuple[str, ...] = ("docs",)) -> DataFrame | None:
        """What the last changes ask for; None where git can't tell."""
        changed = sources.changed_files(self.root)
        if changed is None:
            return None
        paths = self.spark.createDataFrame([(p,) for p in changed], "path string")
        return change_plan(paths, [], source, reference, docs, F.col("path").isin(*CONFIG_FILES))

    def run(self, target: str, store: str, explicit: tuple[str, ...] = (), registry: atoms.Registry = atoms.Registry(), page: Callable[[prompts.Section, dict[str, DataFrame]], DataFrame] | None = None) -> list[tuple[str, str]]:
        """Everything from the tree to its pages: (stage, "made", "kept" or "failed: why") of each stage.

        Outputs are kept in the store by what they are made of: after a failure, or for a tree in which
        little changed, a run makes only what is missing. A section that fails has a page that says
        so; only if all fail does the run. Pages are written below target, all or none. page
        makes a section's page (one row: page) from the outputs; it is section_page() if not given.
        """
        make_page = page or self.section_page
        kept, spark = Store(self.spark, store), self.spark
        before, self.snapshot = self.snapshot, None
        try:
            scanned = self.files(ignore=False)
            tree = content_digest(scanned.select("path", "content"))
            files = kept.stage("files", lambda: scanned, (tree,))
            self.snapshot = files.rows
            rules = list(self.rules.patterns)
            outputs = {}

            def stage(name: str, make: Callable[[], DataFrame], *settings) -> None:
                outputs[name] = kept.stage(name, make, (files,), [rules, *settings])

            code = self.code()
            for name, rows in code.items():
                stage(name, lambda rows=rows: rows)
            stage("manifest", self.scan)
            stage("evidence", self.evidence)
            stage("chunks", self.ground, [self.sizes])
            stage("references", lambda: self.discover(explicit), explicit)
            stage("claims", lambda: self.evaluate(registry, explicit), explicit, [registry])
            tables = {name: o.rows for name, o in outputs.items()}
            state = [(o.name, "made" if o.made else "kept") for o in kept.told]
            written, failed = [], []
            for section in prompts.SECTIONS:
                try:
                    one = kept.stage(f"page-{section.name}", lambda s=section: make_page(s, tables).select("page"), tuple(outputs.values()), [section])
                    written.append((section, one.rows))
                    state.append((one.name, "made" if one.made else "kept"))
                except Exception as why:  # noqa: BLE001  one section's failure is told on its page
                    failed.append((section, type(why).__name__))
                    state.append((f"page-{section.name}", f"failed: {type(why).__name__}"))
            if not written:
                raise RuntimeError("no section could be made: " + ", ".join(sorted({why for _, why in failed})))
            rows = [one.select(F.lit(f"{s.name}.md").alias("path"), "page") for s, one in written]
            if failed:
                rows.append(spark.createDataFrame([(f"{s.name}.md", f"# {s.title}\n\n<!-- {MANAGED[0]} -->\n\nThis section could not be made ({why}).\n") for s, why in failed], "path string, page string"))
            pages.save_pages(reduce(DataFrame.unionByName, rows), target, title="Pages")
            return state
        finally:
            self.snapshot = before

    def section_page(self, section: prompts.Section, tables: dict[str, DataFrame]) -> DataFrame:
        """A section's page from facts alone: what the scan found, the evidence, code and references, and of a
        section with a route its claims."""
        one, names = (section,), lambda text: {section.name: text}
        top = tables["manifest"].select(
            F.explode(F.array(*(F.struct(F.lit(i).alias("a"), F.concat(F.lit(f"- {c.replace('_', ' ')}: "), F.coalesce(F.nullif(F.array_join(F.col(c), ", "), F.lit("")), F.lit("none"))).alias("line")) for i, c in enumerate(("top_level_directories", "top_level_files"))))).alias("x")
        ).select("x.a", F.lit("").alias("b"), "x.line")
        chosen = rendering.authoritative(tables["evidence"].select("category", "path"), (section.name,))
        shown = chosen.select("section", F.col("place").alias("a"), F.lit("").alias("b"), F.concat(F.lit("- "), "path").alias("line"))
        modules = tables["modules"].select("module_name", F.col("module_importance_score").alias("score"), F.col("is_test_module").alias("is_test"))
        facts = select_facts(modules, tables["symbols"], tables["imports"], tables["entrypoints"], tables["excerpts"], tuple(b for b in BUDGETS if b[0] == section.name))
        lines = {
            "Modules": ("modules", F.col("module_name")), "Symbols": ("symbols", F.concat_ws(":", "module_name", "symbol_name")), "Imports": ("imports", F.concat_ws(" -> ", "source_module", "imported_module")),
            "Entrypoints": ("entrypoints", F.col("label")),
        }
        found = tables["references"].select(F.lit(0).alias("a"), F.col("path").alias("b"), F.concat(F.lit("- "), "path", F.lit(" ("), "parse_status", F.lit(")")).alias("line"))
        blocks = [
            prompts.Block(names(f"# {section.title}\n\n<!-- {MANAGED[0]} -->"), none=""),
            prompts.Block(names("## Repository\n"), prompts.for_all(top, one)),
            prompts.Block(names("## Evidence\n"), shown, "- None"),
            *(prompts.Block(names(f"## {title}\n"), facts[name].select("section", F.col("place").alias("a"), F.lit("").alias("b"), F.concat(F.lit("- "), value).alias("line")), "- None") for title, (name, value) in lines.items()),
            prompts.Block(names("## References\n"), prompts.for_all(found, one), "- None"),
        ]
        if section.route:
            route = F.create_map(*(F.lit(x) for name, (_, r) in discovery.KINDS.items() for x in (name, r)))[F.col("route")]
            own = tables["claims"].filter(route == section.route)
            counts = own.groupBy("verdict").agg(F.count("*").alias("n")).select(F.lit(0).alias("a"), F.col("verdict").alias("b"), F.concat(F.lit("- "), "verdict", F.lit(": "), F.col("n").cast("string")).alias("line"))
            first = own.orderBy("path", "ordinal").limit(prompts.MATERIALS).select(F.lit(1).alias("a"), F.concat_ws(":", "path", F.lpad(F.col("ordinal").cast("string"), 9, "0")).alias("b"), F.concat(F.lit("- "), "claim", F.lit(" ("), "verdict", F.lit(")")).alias("line"))
            blocks.append(prompts.Block(names("## Claims\n"), prompts.for_all(counts.union(first), one), "- None"))
        made = prompts.assemble(self.spark, one, blocks)
        return made.select(F.concat("prompt", F.lit("\n")).alias("page"))
