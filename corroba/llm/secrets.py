"""Operator 9: secret scans through a trigram inverted index.

Each rule's regular expression is parsed, and from it follows a Boolean query over trigrams
(three bytes of the UTF-8 text, A-Z lower-cased) that every text with a match satisfies:
literals and small classes that follow one another make strings, alternatives are united, what
may be absent tells nothing. A task indexes its documents in segments: in one pass over a
segment's trigrams it makes a posting list, as a bitmap of rows, of each trigram that a rule
asks for. Postings are intersected and united as the query says, and only candidates are
searched with the expression. Rules without mandatory trigrams are searched for in every
document.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.llm._common import as_bytes, field_or_empty, slices, small_batches, table, tidy


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Characters that a match (or its group) has at least.
    least: int = 0
    group: int = 0


#: The base kinds are given; the others are public token formats.
RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("payment", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
)
BASE = ("assign", "access", "hex")

#: Strings that a part of an expression is spelled out into, and their characters, at most; beyond it nothing is asked across its end.
SPELLED, SPELLED_CHARS = 128, 64
#: Places of a segment whose trigrams are looked up at a time: a worker holds about 24 bytes for each.
STEP = 1 << 19
_LOWER = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Letters that other than A-Z and a-z match if Unicode's case is ignored.
_FOLDED = frozenset("iksIKS")

# A query is a list of clauses, all of which must hold; a clause is a set of alternatives, and
# an alternative a set of trigrams, all of which must occur.
Query = list[frozenset[frozenset[bytes]]]


def _asked(strings: frozenset[str]) -> Query:
    """That one of the strings occurs."""
    alternatives = set()
    for raw in (s.encode(errors="surrogatepass").translate(_LOWER) for s in strings):
        if len(raw) < 3:
            return []
        alternatives.add(frozenset(raw[i : i + 3] for i in range(len(raw) - 2)))
    return [frozenset(a for a in alternatives if not any(b < a for b in alternatives))]


def _either(queries: list[Query]) -> Query:
    """That one of the queries holds, or less: each gives its most telling clause."""
    if not all(queries):
        return []
    return [frozenset().union(*(max(q, key=lambda c: min(map(len, c))) for q in queries))]


def _characters(item: tuple, flags: int) -> frozenset[str] | None:
    """The characters of a class, if they are few and known."""
    if item[0] is op.LITERAL:
        found = {chr(item[1])}
    elif item[0] is op.IN and all(x[0] in (op.LITERAL, op.RANGE) for x in item[1]):
        size = sum(1 if x[0] is op.LITERAL else x[1][1] - x[1][0] + 1 for x in item[1])
        if size > SPELLED:
            return None
        found = {chr(c) for kind, x in item[1] for c in ((x,) if kind is op.LITERAL else range(x[0], x[1] + 1))}
    else:
        return None
    if flags & re.IGNORECASE:
        if not flags & re.ASCII and any(c in _FOLDED or not c.isascii() for c in found):
            return None
        found = {c.lower() if c.isascii() else c for c in found}
    return frozenset(found)


def _sequence(items: Iterable, flags: int) -> tuple[frozenset[str] | None, Query]:
    """(the strings that the items match, if they can be spelled out; what else a match asks)."""
    query, strings, whole = [], frozenset({""}), True
    for item in items:
        spelled, more = _part(item, flags)
        if spelled is not None and len(strings) * len(spelled) <= SPELLED and max(map(len, strings)) + max(map(len, spelled)) <= SPELLED_CHARS:
            strings = frozenset(a + b for a, b in product(strings, spelled))
            continue
        query += _asked(strings)
        whole = False
        strings = spelled if spelled is not None else frozenset({""})
        query += more
    return (strings, []) if whole else (None, query + _asked(strings))


def _part(item: tuple, flags: int) -> tuple[frozenset[str] | None, Query]:
    kind, value = item
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):  # of no width
        return frozenset({""}), []
    if kind is op.SUBPATTERN:
        _, add, off, items = value
        if add & (re.ASCII | re.UNICODE | re.LOCALE):
            flags &= ~(re.ASCII | re.UNICODE | re.LOCALE)
        return _sequence(items, (flags | add) & ~off)
    if kind is op.ATOMIC_GROUP:
        return _sequence(value, flags)
    if kind is op.BRANCH:
        parts = [_sequence(items, flags) for items in value[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= SPELLED:
            return frozenset().union(*(s for s, _ in parts)), []
        return None, _either([q if s is None else _asked(s) for s, q in parts])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, items = value
        if (least, most) == (0, 1):
            spelled, _ = _sequence(items, flags)
            return (spelled | {""} if spelled is not None else None), []
        one = list(items) * min(least, SPELLED_CHARS)
        spelled, query = _sequence(one, flags)
        if spelled is not None and least == most <= SPELLED_CHARS:
            return spelled, []
        return None, query if spelled is None else _asked(spelled)
    found = _characters(item, flags)
    return found, []


def trigram_query(pattern: str) -> Query:
    """What the trigrams of every text that the expression matches satisfy; empty if nothing."""
    parsed = _parser.parse(pattern)
    spelled, query = _sequence(parsed, parsed.state.flags)
    return query if spelled is None else _asked(spelled)


class Segment:
    """Postings over the rows of a segment: for each asked trigram, which rows have it."""

    def __init__(self, texts: list[bytes], asked: dict[bytes, int], wanted: np.ndarray):
        """wanted: by trigram as a number, its place among the asked ones, or -1."""
        raw = np.frombuffer(b"\xff\xff".join([*texts, b""]).translate(_LOWER), np.uint8)  # no text has that byte
        self.asked, self.rows = asked, len(texts)
        self.postings = np.zeros((len(asked), len(texts)), bool)
        ends = np.cumsum([len(t) + 2 for t in texts])
        for at in range(0, max(0, len(raw) - 2), STEP):
            part = raw[at : at + STEP + 2].astype(np.int32)
            which = wanted[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            found = np.flatnonzero(which >= 0)
            self.postings[which[found], np.searchsorted(ends, found + at, "right")] = True

    def candidates(self, query: Query) -> np.ndarray:
        rows = np.ones(self.rows, bool)
        for clause in query:
            either = np.zeros(self.rows, bool)
            for alternative in clause:
                either |= self.postings[[self.asked[g] for g in alternative]].all(0)
            rows &= either
        return np.flatnonzero(rows)


def index_of(queries: list[Query]) -> tuple[dict[bytes, int], np.ndarray]:
    """The asked trigrams and their places, as a dictionary and by number."""
    asked = {g: i for i, g in enumerate(sorted({g for q in queries for clause in q for a in clause for g in a}))}
    wanted = np.full(1 << 24, -1, np.int16 if len(asked) < 1 << 15 else np.int32)
    for g, i in asked.items():
        wanted[int.from_bytes(g, "big")] = i
    return asked, wanted


def matches(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if len(m[rule.group]) >= rule.least]


SPANS = "array<struct<kind:string,start:int,stop:int>>"


def _scanned(batches: Iterable[pa.RecordBatch], place: int, rules: tuple[Rule, ...], queries: list[Query]) -> Iterator[tuple[pa.RecordBatch, dict[int, str], list[list[tuple]]]]:
    """Small batches of rows (in their first column, the text in the field at `place`) with the texts
    that were searched, by row, and each row's spans: start, number of the rule, stop, sorted."""
    compiled = [re.compile(r.pattern) for r in rules]
    asked, wanted = index_of(queries)
    for batch in slices(batches, 256):
        raw = as_bytes(field_or_empty(batch.column(0), place))
        segment = Segment(raw, asked, wanted)
        texts: dict[int, str] = {}
        found: list[list[tuple]] = [[] for _ in raw]
        for k, (rule, query) in enumerate(zip(rules, queries)):
            for i in segment.candidates(query):
                if i not in texts:
                    texts[i] = raw[i].decode()
                found[i] += [(a, k, b) for a, b in matches(rule, compiled[k], texts[i])]
        yield batch, texts, [sorted(x) for x in found]


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of docs (in `doc`) and `secrets`: kind, start and stop (code points, stop
    exclusive) by start, then in the order of the rules.

    Null and empty texts have none; repeated rows are searched each; an empty table gives no
    rows; columns named like those added stay inside `doc`. A text is searched whole.
    """
    small_batches(docs.sparkSession)
    queries = [trigram_query(r.pattern) for r in rules]
    place = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        for batch, _, found in _scanned(batches, place, rules, queries):
            rows = [[{"kind": rules[k].kind, "start": a, "stop": b} for a, k, b in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc", "secrets"])

    given = docs.select(F.struct("*").alias("doc"))
    return given.mapInArrow(lambda b: tidy(run(b)), given.withColumn("secrets", F.lit(None).cast(SPANS)).schema)


def _without(text: str, spans: list[tuple], rules: tuple[Rule, ...], mark: str) -> str:
    out, at = [], 0
    for start, k, stop in spans:
        if start >= at:
            out += [text[at:start], mark.format(kind=rules[k].kind)]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[{kind}]") -> DataFrame:
    """docs with each span of a secret replaced by its mark; overlapping spans are replaced as
    one, under the first's kind. n_chars, where there is one, is the new text's.

    Texts are searched and replaced in the same worker; only those that change come back beside
    their rows."""
    small_batches(docs.sparkSession)
    rules, queries, place = RULES, [trigram_query(r.pattern) for r in RULES], docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, found in _scanned(batches, place, rules, queries):
            new = [_without(texts[i], spans, rules, mark) if spans else None for i, spans in enumerate(found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["doc", "new_text"])

    given = docs.select(F.struct("*").alias("doc"))
    out = given.mapInArrow(lambda b: tidy(run(b)), given.withColumn("new_text", F.lit(None).cast("string")).schema)
    columns = {"text": F.coalesce("new_text", "doc.text")}
    if "n_chars" in docs.columns:
        changed = F.col("new_text") != F.col("doc.text")
        columns["n_chars"] = F.when(changed, F.length("new_text")).otherwise(F.col("doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(columns.get(c, F.col(f"doc.{c}")).alias(c) for c in docs.columns))


def _is(kind: str):
    return lambda span: span["kind"] == kind


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("secrets", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc.doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
