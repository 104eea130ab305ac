"""What of a corpus a section's prompt shows, and the prompt.

Every section ranks all chunks by its keywords and takes what its budget allows. A prompt is
made of blocks; each block's lines are rows of a table of its own (evidence, sources, modules,
symbols, imports, entrypoints, excerpts, chunks, materials), tagged with section, block and place.
One union of all tables is folded in that order, so no table is joined with another.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroba.operators.patterns import with_hits
from corroba.operators.ranking import greedy_budget
from corroba.operators.spread import spread


@dataclass(frozen=True)
class Section:
    """A page to be written: the words that its chunks have, and its budget: chunks, characters in
    all, and characters of a chunk."""

    name: str
    keywords: tuple[str, ...]
    most: int
    total: int
    each: int
    title: str = ""
    purpose: str = ""
    focus: tuple[str, ...] = ()
    headings: tuple[str, ...] = ()
    #: The route whose materials the prompt shows.
    route: str | None = None


_CLAIM_HEADINGS = ("Claims and Evidence", "Interpretation", "Contradictions", "Limits of the Evidence")
# The sections' names, keywords and budgets.
SECTIONS = (
    Section("overview", ("overview", "readme", "summary", "purpose", "goal", "intro"), 4, 2600, 800, "Overview", "what the project is and who would use it", (), ("Evidence", "Interpretation", "Limits of the Evidence")),
    Section("architecture", ("architecture", "module", "component", "boundary", "dependency", "integration", "entrypoint"), 6, 4200, 1000, "Architecture", "parts, their tasks and what lies between them",
            ("Look at structure and responsibilities that the evidence shows.",), ("Evidence", "Parts and Boundaries", "Limits of the Evidence")),
    Section("code_structure", ("structure", "module", "package", "symbol", "import", "dependency", "test"), 6, 4200, 1000, "Code Structure", "modules and how they are grouped",
            ("Look at the modules that were found and how they belong together.",), ("Evidence", "Modules and Groups", "Limits of the Evidence")),
    Section("runtime_entrypoints", ("entrypoint", "runtime", "cli", "command", "main", "typer", "argparse"), 5, 3000, 900, "Runtime Entrypoints", "how the program is started",
            ("Look at what shows a start of the program, and what to mind there.",), ("Evidence", "Ways to Start", "Limits of the Evidence")),
    Section("theory_alignment", ("theory", "alignment", "method", "principle", "assumption", "constraint", "mismatch"), 8, 5600, 1100, "Theory Alignment", "where the code follows the references' ideas",
            ("Tell clear alignment from what has no evidence.",), _CLAIM_HEADINGS),
    Section("reference_alignment", ("reference", "alignment", "claim", "supported", "contradicted", "missing"), 8, 5600, 1100, "Reference Alignment", "which claims of the references the code supports",
            ("Statuses: supported, partially_supported, missing_evidence, contradicted.", "Cite no evidence id but those given."), _CLAIM_HEADINGS, "general_reference_alignment"),
    Section("agent_instruction_alignment", ("agent", "instruction", "workflow", "config", "command"), 5, 3600, 900, "Agent Instruction Alignment", "which instructions to agents the code bears out",
            ("Statuses: supported, partially_supported, not_evidenced, contradicted, out_of_scope_or_non_verifiable.", "Cite no evidence id but those given."), _CLAIM_HEADINGS, "agent_instruction_alignment"),
    Section("readme_claim_alignment", ("readme", "claim", "install", "command", "output", "llm"), 5, 3600, 900, "README Claim Alignment", "which claims of the README the code supports",
            ("Statuses: supported, partially_supported, not_evidenced, contradicted, not_statically_verifiable.", "Cite no evidence id but those given."), _CLAIM_HEADINGS, "readme_claim_alignment"),
)
# What a keyword and the section's own name count, and how much of a text is looked at.
KEYWORD, OWN_NAME, LOOKED_AT = 5, 6, 400
#: Materials of a route, and sources that a prompt lists; of more sources it tells the number.
MATERIALS, LISTED = 10, 200
CHUNK = ["path", "chunk_index", "chunk_id"]


def relevance(chunks: DataFrame, sections: tuple[Section, ...] = SECTIONS, scanned: bool = False) -> DataFrame:
    """path, chunk_index, chunk_id, n (characters), section, score: every chunk (with text and
    section_hint) for every section. Keywords are looked for in path, hint and the text's first
    LOOKED_AT characters, in lower case, as parts of words, too; each counts once.

    scanned: whether chunks are a scan with narrow steps only; they are then dealt to tasks of a bounded
    number of rows, as each comes to a row a section, which rankings sort in their tasks."""
    words = sorted({k for s in sections for k in s.keywords})
    hint = F.lower(F.coalesce("section_hint", F.lit("")))
    looked_at = F.concat_ws(" ", F.lower("path"), hint, F.lower(F.left("text", F.lit(LOOKED_AT))))
    given = chunks.select(*CHUNK, F.length("text").cast("long").alias("n"), F.replace(hint, F.lit("-"), F.lit("_")).alias("hint"), looked_at.alias("looked_at"))
    given = spread(given) if scanned else given
    found = with_hits(given.select(*CHUNK, "n", "hint", "looked_at"), F.col("looked_at"), words).drop("looked_at")

    def score(s: Section) -> Column:
        own = F.array(*(F.lit(i) for i, w in enumerate(words) if w in s.keywords)).cast("array<int>")
        named = F.when(F.contains("hint", F.lit(s.name)), OWN_NAME).otherwise(0)
        return F.struct(F.lit(s.name).alias("section"), (KEYWORD * F.size(F.array_intersect("hits", own)) + named).cast("long").alias("score"))

    return found.select(*CHUNK, "n", F.explode(F.array(*map(score, sections))).alias("s")).select(*CHUNK, "n", "s.section", "s.score")


def selected(chunks: DataFrame, sections: tuple[Section, ...] = SECTIONS, scanned: bool = False) -> DataFrame:
    """section, place, total, path, chunk_index, chunk_id: what each section's budget takes of its ranking:
    relevance, then path, index and id. scanned: as relevance() has it."""
    of = lambda value: F.create_map(*(F.lit(x) for s in sections for x in (s.name, value(s))))[F.col("section")]
    ranked = relevance(chunks, sections, scanned).select("section", (-F.col("score")).alias("low"), *CHUNK, F.struct(*CHUNK).alias("chunk"), "n")
    picked = greedy_budget(ranked, "section", ["low", *CHUNK], "chunk", "n", of(lambda s: s.most), of(lambda s: s.each), of(lambda s: s.total), largest=max(s.most for s in sections))
    return picked.select("section", "place", "total", "chunk.*")


@dataclass(frozen=True)
class Block:
    """Lines under a header. header: by section; {n} in it is the number of lines. lines: section, a, b (order),
    line. none stands where a section has no line; if it is None, the block is left out there."""

    header: dict[str, str]
    lines: DataFrame | None = None
    none: str | None = None
    gap: str = "\n"


def for_all(rows: DataFrame, sections: tuple[Section, ...]) -> DataFrame:
    """The same few lines (a, b, line) for every section."""
    return rows.select(F.explode(F.array(*(F.lit(s.name) for s in sections))).alias("section"), "a", "b", "line")


def assemble(spark: SparkSession, sections: tuple[Section, ...], blocks: list[Block]) -> DataFrame:
    """section, prompt: the blocks in order, an empty line between them."""
    heads = [(s.name, k, -1, "", b.header[s.name]) for k, b in enumerate(blocks) for s in sections if s.name in b.header]
    tagged = [spark.createDataFrame(heads, "section string, block int, a long, b string, line string")]
    tagged += [b.lines.select("section", F.lit(k).alias("block"), F.col("a").cast("long").alias("a"), F.col("b").cast("string").alias("b"), "line") for k, b in enumerate(blocks) if b.lines is not None]
    each = reduce(DataFrame.unionByName, tagged).groupBy("section", "block").agg(F.array_sort(F.collect_list(F.struct("a", "b", "line"))).alias("rows"))
    n = F.size("rows") - 1
    pick = lambda f: F.element_at(F.array(*(F.lit(f(b)) for b in blocks)), F.col("block") + 1)
    head = F.replace(F.col("rows")[0]["line"], F.lit("{n}"), n.cast("string"))
    body = F.array_join(F.transform(F.slice("rows", 2, F.greatest(n, F.lit(1))), lambda x: x["line"]), "\0")
    body = F.when(n > 0, F.concat(pick(lambda b: b.gap), F.replace(body, F.lit("\0"), pick(lambda b: b.gap)))).when(pick(lambda b: b.none) != "", F.concat(F.lit("\n"), pick(lambda b: b.none))).otherwise("")
    kept = each.filter((n > 0) | pick(lambda b: b.none).isNotNull()).select("section", "block", F.concat(head, body).alias("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"])
    return kept.groupBy("section").agg(F.array_join(parts, "\n\n").alias("prompt"))


def task(s: Section) -> str:
    """What a section asks for: the same words in each prompt."""
    lines = [f"[TASK {s.name}]", f"Write the page \"{s.title}\": {s.purpose}.", *s.focus, "Facts of the scan and the code decide; references only explain.", "Name the evidence of each statement; mark what is inferred; say where evidence is missing.",
             "Invent no files, modules, interfaces, tests or behaviour.", "Use these headings:", *(f"- {h}" for h in s.headings)]
    return "\n".join(lines)


def answer_form(s: Section) -> str:
    """The JSON that an answer has."""
    keys = ", ".join(f'"{h}": [...]' for h in s.headings)
    return "\n".join(["[ANSWER]", "One JSON object and nothing else:", f'{{"title": "{s.title}", "section_blocks": {{{keys}}}}}',
                      'A block is {"kind": "paragraph" | "bullet" | "labeled_bullet" | "numbered_item", "text": "..."}; a labeled_bullet has a "label", too.'])


def chunk_lines(chunks: DataFrame, taken: DataFrame, sections: tuple[Section, ...]) -> DataFrame:
    """The chunks taken (selected()), with where they come from, cut to what a section shows of each."""
    each = F.create_map(*(F.lit(x) for s in sections for x in (s.name, s.each)))[F.col("section")]
    own = chunks.join(F.broadcast(taken), CHUNK)  # taken: the budgets' number of rows
    shown = F.concat(F.lit("[CHUNK "), F.col("place").cast("string"), F.lit("] "), "chunk_id", F.lit("\nsource: "), "path", F.lit("\nhint: "), F.coalesce("section_hint", F.lit("(none)")), F.lit("\n"), F.substring("text", F.lit(1), each))
    return own.select("section", F.col("place").alias("a"), F.lit("").alias("b"), shown.alias("line"))


def material_lines(materials: DataFrame, sections: tuple[Section, ...], most: int = MATERIALS) -> DataFrame:
    """The first materials (route, ordinal, source_path, section_hint, excerpt) of each section's route. Each
    route's are chosen by a limit, which keeps `most` rows a task; a window would sort all with their texts."""
    routed = [s for s in sections if s.route]
    if not routed:
        return materials.select(F.lit("").alias("section"), F.lit(0).alias("a"), F.lit("").alias("b"), F.lit("").alias("line")).filter(F.lit(False))
    each = [materials.filter(F.col("route") == s.route).orderBy("ordinal").limit(most).withColumn("section", F.lit(s.name)) for s in routed]
    first = reduce(DataFrame.unionByName, each).withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy("ordinal")))
    line = F.concat(F.lit("## item "), F.col("place").cast("string"), F.lit("\nsource: "), "source_path", F.lit("\nhint: "), F.coalesce("section_hint", F.lit("(none)")), F.lit("\n"), "excerpt")
    return first.select("section", F.col("place").alias("a"), F.lit("").alias("b"), line.alias("line"))


def source_lines(sources: DataFrame, sections: tuple[Section, ...], most: int = LISTED) -> DataFrame:
    """The first sources (path, extension, size_bytes) by path, and how many more there are."""
    first = sources.orderBy("path").limit(most).select(F.lit(0).cast("long").alias("a"), F.col("path").alias("b"), F.concat(F.lit("- "), "path", F.lit(" ("), "extension", F.lit(", "), F.col("size_bytes").cast("string"), F.lit(" bytes)")).alias("line"))
    rest = sources.agg((F.count("*") - most).alias("n")).filter("n > 0").select(F.lit(1).cast("long").alias("a"), F.lit("").alias("b"), F.concat(F.lit("- and "), F.col("n").cast("string"), F.lit(" more")).alias("line"))
    return for_all(first.union(rest), sections)


def prompts(chunks: DataFrame, facts: DataFrame, evidence: DataFrame, sources: DataFrame, code: dict[str, DataFrame], materials: DataFrame, sections: tuple[Section, ...] = SECTIONS, scanned: bool = False) -> DataFrame:
    """section, prompt. chunks: path, chunk_index, chunk_id, text, section_hint; facts: place, line; evidence:
    section, place, category, path, line_count, excerpt (as authoritative() chooses); sources: path,
    extension, size_bytes; code: tables of section, place and line, by name, in the order in which
    they are shown; materials: route, ordinal, source_path, section_hint, excerpt. Any may be empty.
    scanned: as relevance() has it."""
    head = lambda text: {s.name: text for s in sections}
    shown = F.concat(F.lit("## "), "category", F.lit(": "), "path", F.lit("\nlines: "), F.col("line_count").cast("string"), F.lit("\n"), "excerpt")
    taken = selected(chunks, sections, scanned)
    blocks = [
        Block({s.name: task(s) for s in sections}, none=""),
        Block(head("[FACTS OF THE SCAN]"), for_all(facts.select(F.col("place").alias("a"), F.lit("").alias("b"), "line"), sections), "(none)"),
        Block(head("[EVIDENCE: {n}]"), evidence.select("section", F.col("place").alias("a"), F.lit("").alias("b"), shown.alias("line")), "No evidence was found.", "\n\n"),
        Block(head("[REFERENCES]"), source_lines(sources, sections), "No references were found."),
        *(Block(head(f"[{name.upper()}: {{n}}]"), rows.select("section", F.col("place").alias("a"), F.lit("").alias("b"), "line"), "- None") for name, rows in code.items()),
        Block({s.name: answer_form(s) for s in sections}, none=""),
        Block({s.name: f"[REFERENCE CHUNKS: {{n}} of at most {s.most}, {s.each} characters each, {s.total} in all]" for s in sections}, chunk_lines(chunks, taken, sections), None, "\n\n"),
        Block({s.name: f"[MATERIAL OF {s.route}: {{n}}]" for s in sections if s.route}, material_lines(materials, sections), None, "\n\n"),
    ]
    spark = chunks.sparkSession
    return assemble(spark, sections, blocks)
