"""Ignore patterns: ordered, the last match wins, `!` takes back, a final `/` means directories."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an analysis of a tree leaves out by default.
DEFAULT_PATTERNS = (
    ".git/", ".venv/", "venv/", "env/", "__pycache__/", ".pytest_cache/", ".ruff_cache/", ".mypy_cache/", ".tox/", ".nox/",
    ".coverage", ".coverage.*", "htmlcov/", "build/", "dist/", "*.egg-info/", ".eggs/", "*.sqlite", "*.sqlite3", "*.db",
    "*.db-*", "*.db3", "*.mdb", "*.parquet", "*.duckdb", ".claude/", ".cursor/", ".codex/", ".aider/", ".continue/",
    "README.md", "**/AGENTS.md", "**/CLAUDE.md", "**/CODEX.md", "**/CURSOR.md", "**/AIDER.md", "**/CONTINUE.md", "**/GEMINI.md",
)


def read_patterns(lines: Iterable[str]) -> list[str]:
    """Patterns of an ignore file: stripped, without blank lines and comments, with forward slashes."""
    found = (line.strip().replace("\\", "/") for line in lines)
    return [p for p in found if p and not p.startswith("#")]


def stack(*groups: Iterable[str], unignore: Iterable[str] = ()) -> tuple[str, ...]:
    """Groups of patterns one after the other, then those to take back."""
    return tuple(p for g in groups for p in g) + tuple(f"!{p}" for p in unignore)


def to_regex(pattern: str) -> str:
    """A regular expression, for Java and Python alike, over paths with `/`; directories end in `/`."""
    body = pattern.strip("/")
    anchored = pattern.startswith("/") or "/" in body
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            inner = body[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    start = "^/?" if anchored else "(?:^|/)"
    return start + out + ("/.*$" if pattern.endswith("/") else "(?:/.*)?$")


class IgnoreRules:
    def __init__(self, patterns: Iterable[str]):
        self.patterns = tuple(patterns)
        self.rules = [(to_regex(p.removeprefix("!")), p.startswith("!")) for p in self.patterns]

    def matches(self, path: Column, is_dir: Column) -> Column:
        """Whether a path is ignored: one chain of conditions, the last pattern first."""
        whole = F.when(is_dir & ~path.endswith("/"), F.concat(path, F.lit("/"))).otherwise(path)
        out = None
        for regex, back in reversed(self.rules):
            hit = whole.rlike(regex)
            out = F.when(hit, F.lit(not back)) if out is None else out.when(hit, F.lit(not back))
        return F.lit(False) if out is None else out.otherwise(False)

    def is_ignored(self, path: str, is_dir: bool = False) -> bool:
        whole = path + "/" if is_dir and not path.endswith("/") else path
        for regex, back in reversed(self.rules):
            if re.search(regex, whole):
                return not back
        return False


def owned_paths(root: str, directories: Iterable[str]) -> list[str]:
    """Directories of the tool inside the root, as patterns; the root itself and outside ones are not."""
    prefix = root.rstrip("/") + "/"
    return sorted({d.rstrip("/").removeprefix(prefix) + "/" for d in directories if d.rstrip("/").startswith(prefix)})


def prune(files: DataFrame, rules: IgnoreRules, path: str = "path") -> DataFrame:
    """Files whose own path and all of whose directories are not ignored."""
    steps = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    parents = F.slice(above, 1, F.greatest(F.size(steps) - 1, F.lit(0)))
    return files.filter(~rules.matches(F.col(path), F.lit(False)) & ~F.exists(parents, lambda p: rules.matches(p, F.lit(True))))
