"""Structural facts of Python sources: modules, symbols, imports, entrypoints, hints."""

from __future__ import annotations

import ast
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corroba.functions.text import strip

# Names whose mention hints at a framework, files that start a program, and the
# weights of a module's rank.
FRAMEWORKS = ("argparse", "click", "fastapi", "pytest", "typer")
STARTING_FILES = ("/cli.py", "/main.py", "/__main__.py")
APPS = {"Typer": "typer"}
CLASS_WEIGHT, FUNCTION_WEIGHT, IMPORT_WEIGHT, ENTRY_BONUS, TEST_MALUS = 4, 3, 1, 8, 2

_SYMBOL = pa.struct([("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("signature", pa.string()), ("docstring", pa.string())])
_IMPORT = pa.struct([("target", pa.string()), ("relative", pa.bool_())])
_SYMBOL_DDL = "array<struct<name:string,kind:string,line:int,signature:string,docstring:string>>"
_ENTRY = pa.struct([("mark", pa.string()), ("reason", pa.string())])
PARSED = f"path string, symbols {_SYMBOL_DDL}, imports array<struct<target:string,relative:boolean>>, entrypoints array<struct<mark:string,reason:string>>"

# How many modules, symbols, imports, entrypoints and excerpts a section shows.
BUDGETS = (
    ("overview", 6, 10, 8, 4, 4),
    ("architecture", 14, 24, 24, 8, 10),
    ("theory_alignment", 10, 18, 16, 6, 8),
    ("code_structure", 16, 28, 26, 8, 12),
    ("runtime_entrypoints", 10, 14, 14, 10, 8),
    ("reference_alignment", 10, 18, 16, 6, 8),
    ("agent_instruction_alignment", 10, 18, 16, 6, 8),
    ("readme_claim_alignment", 10, 18, 16, 6, 8),
)
#: Modules that have an excerpt, and its lines.
EXCERPTS, EXCERPT_LINES = 12, 18


def signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    a = node.args
    names = [x.arg for x in a.posonlyargs] + (["/"] if a.posonlyargs else []) + [x.arg for x in a.args]
    if a.vararg:
        names.append(f"*{a.vararg.arg}")
    elif a.kwonlyargs:
        names.append("*")
    names += [x.arg for x in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
    returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    start = "async " if isinstance(node, ast.AsyncFunctionDef) else ""
    return f"{start}{node.name}({', '.join(names)}){returns}"


def is_main_guard(node: ast.stmt) -> bool:
    """Whether a statement is an `if` that compares __name__ with "__main__"."""
    test = node.test if isinstance(node, ast.If) else None
    if not isinstance(test, ast.Compare) or len(test.comparators) != 1:
        return False
    other = test.comparators[0]
    return isinstance(test.left, ast.Name) and test.left.id == "__name__" and isinstance(other, ast.Constant) and other.value == "__main__"


def app_of(call: ast.expr, modules: set[str], names: set[tuple[str, str]]) -> str | None:
    """The library whose app a call makes, by the module's or the class's imported name."""
    called = call.func if isinstance(call, ast.Call) else None
    for name, library in APPS.items():
        if isinstance(called, ast.Attribute) and called.attr == name and isinstance(called.value, ast.Name) and called.value.id == library and library in modules:
            return library
        if isinstance(called, ast.Name) and called.id == name and (library, name) in names:
            return library
    return None


def facts_of(path: str, source: str) -> dict | None:
    """The facts of one file; None if it is no Python."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    symbols = []
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            symbols.append({"name": node.name, "kind": "class", "line": node.lineno, "signature": f"class {node.name}", "docstring": ast.get_docstring(node)})
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            kind = "async_function" if isinstance(node, ast.AsyncFunctionDef) else "function"
            symbols.append({"name": node.name, "kind": kind, "line": node.lineno, "signature": signature(node), "docstring": ast.get_docstring(node)})
    imports = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports += [{"target": x.name, "relative": False} for x in node.names]
        elif isinstance(node, ast.ImportFrom):
            base = "." * node.level + (node.module or "")
            joint = "" if base.endswith(".") or not base else "."
            imports += [{"target": f"{base}{joint}{x.name}", "relative": node.level > 0} for x in node.names]
    found = [("argparse", "argparse is used")] if "argparse" in source else []
    found += [("filename_hint", "the file's name starts a program")] if f"/{path}".endswith(STARTING_FILES) else []
    modules = {x.name for n in ast.walk(tree) if isinstance(n, ast.Import) for x in n.names}
    names = {(n.module, x.name) for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) for x in n.names}
    for node in tree.body:
        if is_main_guard(node):
            found.append(("__main__", "__name__ is compared with __main__"))
        library = app_of(node.value, modules, names) if isinstance(node, ast.Assign) else None
        if library:
            found += [(f"{library}_app:{t.id}", f"an app of {library}") for t in node.targets if isinstance(t, ast.Name)]
    return {"symbols": symbols, "imports": imports, "entrypoints": [{"mark": m, "reason": why} for m, why in dict(found).items()]}


def parse_sources(files: DataFrame) -> DataFrame:
    """path, content of Python files -> PARSED, in Arrow batches; unparsable files are dropped."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                found = facts_of(path, (content or b"").decode("utf-8", "ignore"))
                if found:
                    rows.append((path, found["symbols"], found["imports"], found["entrypoints"]))
            columns = list(zip(*rows)) or [(), (), (), ()]
            kinds = (pa.string(), pa.list_(_SYMBOL), pa.list_(_IMPORT), pa.list_(_ENTRY))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "symbols", "imports", "entrypoints"])

    return files.select("path", "content").mapInArrow(run, PARSED)


def module_name(path):
    """Dotted name of a file in src or tests; `__init__` stands for its package."""
    inner = F.regexp_replace(F.regexp_replace(path, r"^src/", ""), r"\.py$", "")
    return F.regexp_replace(F.replace(inner, F.lit("/"), F.lit(".")), r"\.?__init__$", "")


def code_tables(files: DataFrame) -> dict[str, DataFrame]:
    """modules, symbols, imports, entrypoints, framework_hints and excerpts of the Python files."""
    python = files.filter(F.col("path").endswith(".py") & (F.col("path").startswith("src/") | F.col("path").startswith("tests/")))
    parsed = parse_sources(python).withColumn("module_name", module_name(F.col("path"))).filter("module_name <> ''")
    is_test = F.col("path").startswith("tests/")

    def kinds(*names: str):
        return F.size(F.filter("symbols", lambda s: s["kind"].isin(*names)))

    counted = parsed.select(
        "module_name", F.col("path").alias("relative_path"), F.col("path").endswith("__init__.py").alias("is_package"), F.size("imports").alias("import_count"),
        kinds("class").alias("defined_class_count"), kinds("function", "async_function").alias("defined_function_count"), is_test.alias("is_test_module"),
    )
    starts = F.lit(False)
    for s in STARTING_FILES:
        starts = starts | F.concat(F.lit("/"), F.col("relative_path")).endswith(s)
    score = (
        CLASS_WEIGHT * F.col("defined_class_count") + FUNCTION_WEIGHT * F.col("defined_function_count") + IMPORT_WEIGHT * F.col("import_count")
        + F.when(starts, ENTRY_BONUS).otherwise(0) - F.when(F.col("is_test_module"), TEST_MALUS).otherwise(0)
    )
    scored = counted.withColumn("module_importance_score", score)
    symbols = parsed.select("module_name", F.inline("symbols").alias("symbol_name", "symbol_type", "lineno", "signature", "docstring"))
    hints = F.array(*(F.when(F.contains(F.lower(F.col("content").cast("string")), F.lit(f)), f) for f in FRAMEWORKS))
    return {
        "modules": scored,
        "excerpts": excerpts(scored, python),
        "symbols": symbols.withColumn("is_public", ~F.col("symbol_name").startswith("_")),
        "imports": parsed.select(F.col("module_name").alias("source_module"), F.inline("imports").alias("imported_module", "relative")),
        "entrypoints": parsed.select("module_name", F.col("path").alias("relative_path"), F.inline("entrypoints")).select(
            "module_name", "relative_path", F.concat_ws(":", "module_name", "mark").alias("label"), "reason"
        ),
        "framework_hints": python.select(F.explode(F.array_compact(hints)).alias("hint")).distinct(),
    }


def excerpts(modules: DataFrame, files: DataFrame, most: int = EXCERPTS) -> DataFrame:
    """module_name, relative_path, kind, ordinal, start_line, end_line, excerpt of the best modules: lines
    from the first that begins a function or class, else from the top. Files that are no UTF-8 have none."""
    best = modules.orderBy(F.desc("module_importance_score"), "is_test_module", "module_name").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("module_importance_score"), "is_test_module", "module_name"))  # of `most` rows
    text = F.try_validate_utf8(F.col("content").cast("string"))
    lines = F.split(F.regexp_replace(text, r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")
    given = files.select(F.col("path").alias("relative_path"), F.when(text == "", F.array().cast("array<string>")).otherwise(lines).alias("lines")).filter("lines IS NOT NULL")
    rows = best.withColumn("ordinal", place).select("module_name", "relative_path", F.when(F.col("is_test_module"), "test").otherwise("module").alias("kind"), "ordinal").join(given, "relative_path")
    begins = lambda x: strip(x).rlike(r"^(def |class |async def )")
    starts = F.filter(F.transform("lines", lambda x, i: F.when(begins(x), i + 1)), lambda x: x.isNotNull())
    rows = rows.withColumn("start_line", F.coalesce(F.try_element_at(starts, F.lit(1)), F.lit(1)))
    rows = rows.withColumn("end_line", F.least(F.size("lines"), F.col("start_line") + (EXCERPT_LINES - 1)))
    return rows.select("module_name", "relative_path", "kind", "ordinal", "start_line", "end_line", F.array_join(F.slice("lines", F.col("start_line"), F.lit(EXCERPT_LINES)), "\n").alias("excerpt"))


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of counts over the tables of code facts."""
    modules = tables["modules"].agg(F.count("*").alias("modules"), F.count_if("is_test_module").alias("test_modules"))
    symbols = tables["symbols"].agg(
        F.count("*").alias("symbols"), F.count_if(F.col("symbol_type") == "class").alias("classes"), F.count_if(F.col("symbol_type").isin("function", "async_function")).alias("functions")
    )
    rest = [tables[t].agg(F.count("*").alias(t)) for t in ("imports", "entrypoints", "excerpts")]
    out = modules.join(symbols)  # one row each
    for one in rest:
        out = out.join(one)
    return out.join(tables["framework_hints"].agg(F.array_sort(F.collect_set("hint")).alias("framework_hints")))


def select_facts(modules: DataFrame, symbols: DataFrame, imports: DataFrame, entrypoints: DataFrame, excerpts: DataFrame, budgets: tuple = BUDGETS) -> dict[str, DataFrame]:
    """What each section shows: for modules, symbols, imports, entrypoints and excerpts the rows
    with section and place (from 1). Each is a window over sections, whose group limit works
    before the shuffle; facts are those of the section's modules.

    modules: module_name, score, is_test; symbols: module_name, is_public, lineno, symbol_name;
    imports: source_module, imported_module, relative; entrypoints: module_name, label,
    relative_path; excerpts: module_name, kind, relative_path, start_line, ordinal."""
    spark = modules.sparkSession
    names = ("modules", "symbols", "imports", "entrypoints", "excerpts")
    of = F.broadcast(spark.createDataFrame(list(budgets), "section string, " + ", ".join(f"n_{n} int" for n in names)))
    section, runtime = F.col("section"), F.col("section") == "runtime_entrypoints"

    def first(rows: DataFrame, name: str, *order) -> DataFrame:
        most = max(b[1 + names.index(name)] for b in budgets)
        ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(*order))).filter(F.col("place") <= most)
        return ranked.filter(F.col("place") <= F.col(f"n_{name}"))

    starting = entrypoints.select("module_name").distinct().withColumn("starts", F.lit(True))
    known = modules.join(starting, "module_name", "left")
    # modules alike in what sections tell apart stand in one order in all of them: their first ones are enough, and what is sorted is not yet repeated for each section
    alike = Window.partitionBy("starts", "is_test").orderBy(F.desc("score"), "module_name")
    known = known.withColumn("r", F.row_number().over(alike)).filter(F.col("r") <= max(b[1] for b in budgets)).drop("r")
    offered = known.join(of, (section != "overview") | ~F.col("is_test"))
    unstarted = runtime & F.col("starts").isNull()
    chosen = first(offered, "modules", unstarted, F.col("is_test") & (runtime | (section == "code_structure")), F.desc("score"), "is_test", "module_name")
    own = F.broadcast(chosen.select("section", *(f"n_{n}" for n in names[1:]), "module_name", F.coalesce("starts", F.lit(False)).alias("starts")))  # as many rows as the budgets allow

    found = {"modules": chosen.select("section", "place", "module_name")}
    shown = first(symbols.join(own, "module_name"), "symbols", ~F.col("is_public"), "module_name", "lineno", "symbol_name")
    found["symbols"] = shown.select("section", "place", "module_name", "symbol_name", "lineno")
    # Spark takes a semi join, but no inner one, below a distinct of the imports: few are left to be compared
    edges = imports.withColumnRenamed("source_module", "module_name").join(own.select("module_name"), "module_name", "left_semi").join(own, "module_name")
    found["imports"] = first(edges, "imports", "module_name", "imported_module", "relative").select("section", "place", F.col("module_name").alias("source_module"), "imported_module", "relative")
    # the budget counts labels in order; only then the runtime section puts apps and guards first
    kept = first(entrypoints.join(own, "module_name"), "entrypoints", "label")
    order = (runtime & ~F.col("label").contains("_app"), runtime & ~F.col("label").contains("__main__"), F.when(runtime, F.col("relative_path")), "label")
    found["entrypoints"] = kept.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(*order))).select("section", "place", "label")
    is_test = F.col("kind") == "test"
    last = (section.isin("overview", "architecture") & is_test) | (runtime & ~F.col("starts"))
    shown = first(excerpts.join(own, "module_name"), "excerpts", last, runtime & is_test, F.when(runtime, F.col("relative_path")), F.when(runtime, F.col("start_line")), "ordinal")
    found["excerpts"] = shown.select("section", "place", "module_name", "start_line")
    return found
