"""Operator 1: benchmark decontamination with a broadcast hash set of benchmark n-grams.

Words: A-Z lower-cased, runs of digits, letters and all non-ASCII characters. Each task
looks up the hash of every window of its documents' words, verifies the words of each
window found, and marks the words. The benchmark is broadcast in shards of bounded size:
a larger one is scanned for shard by shard, so no worker holds more than one. Long items are
cut into pieces that overlap by a window less a word, so they have the same windows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.llm._common import as_bytes, field_or_empty, materialise, slices, table, text_or_empty, tidy

WINDOW = 10
#: Text bytes of the benchmark that one broadcast holds, about: a word takes two bytes at least, a window some 20 bytes
#: beside its words. Items are cut into pieces of about PIECE_BYTES.
SHARD_BYTES, PIECE_BYTES = 4 << 20, 256 << 10
_WORD = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_BITS = 22


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class Windows:
    """The distinct windows of benchmark items: where each lies among all words, its hash, and
    the items that have it, in arrays."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        found: dict[int, list[tuple[int, int, int]]] = {}  # by length: first and last place, item
        ids: list[np.ndarray] = [np.zeros(0, np.int32)]
        at = 0
        for item, text in items:
            words = words_of(text)
            n = min(window, len(words))
            if n:
                ids.append(np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), np.int32, len(words)))
                found.setdefault(n, []).append((at, at + len(words) - n + 1, place[item]))
                at += len(words)
        self.ids = np.concatenate(ids)
        self.by_length = []
        for n, runs in sorted(found.items()):
            starts = np.concatenate([np.arange(a, b, dtype=np.int64) for a, b, _ in runs])
            owner = np.concatenate([np.full(b - a, item, np.int32) for a, b, item in runs])
            seed = 0
            while True:  # until no two windows of different words share a hash
                multipliers = _multipliers(n, seed)
                hashes = _hashes(self.ids, n, multipliers)[starts]
                order = np.argsort(hashes, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0]))
                which = np.zeros(len(order), np.int64)
                which[first[1:]] = 1
                which = np.cumsum(which)  # of each window in order, its distinct one
                if all((self.ids[starts[order] + k] == self.ids[starts[order[first]][which] + k]).all() for k in range(n)):
                    break
                seed += 1
            pairs = np.unique(which * len(self.names) + owner[order])
            marks = np.zeros(1 << _BITS, bool)
            marks[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            ends = np.searchsorted(pairs, np.arange(len(first) + 1) * len(self.names))
            self.by_length.append((n, multipliers, hashes[order[first]], starts[order[first]], ends, (pairs % len(self.names)).astype(np.int32), np.packbits(marks)))

    def hits(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, number of words, items) of each window found; ends: where documents end."""
        for n, multipliers, hashes, starts, of, items, marked in self.by_length:
            if len(ids) < n:
                continue
            h = _hashes(ids, n, multipliers)
            at = np.flatnonzero(np.unpackbits(marked).view(bool)[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            if not len(at):
                continue
            k = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
            same = (ids[at[:, None] + np.arange(n)] == self.ids[starts[k][:, None] + np.arange(n)]).all(1)
            same &= np.searchsorted(ends, at, "right") == np.searchsorted(ends, at + n - 1, "right")
            for p, w in zip(at[same].tolist(), k[same].tolist()):
                yield p, n, [self.names[i] for i in items[of[w] : of[w + 1]]]


def _pieces(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """item, words (one space between them) of the items' pieces."""
    for batch in slices(batches):
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            words = words_of(text)
            step = max(window, PIECE_BYTES * len(words) // max(1, len(text)))
            rows += [(item, b" ".join(words[at : at + step + window - 1])) for at in range(0, max(1, len(words) - window + 1), step)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.binary())], names=["item", "words"])


def _multipliers(n: int, seed: int) -> list[np.uint64]:
    digest = hashlib.shake_128(f"window {n} {seed}".encode()).digest(8 * n)
    return [np.uint64(int.from_bytes(digest[8 * i : 8 * i + 8], "little") | 1) for i in range(n)]


def _hashes(ids: np.ndarray, n: int, multipliers: list[np.uint64]) -> np.ndarray:
    u = ids.astype(np.uint64)
    h = np.zeros(len(u) - n + 1, np.uint64)
    for i, m in enumerate(multipliers):
        h += u[i : len(u) - n + 1 + i] * m
    return (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


FOUND = "n_words long, n_hit long, spans array<struct<first:int,words:int>>, items array<string>"


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """All columns of docs (in `doc`) with n_words, n_hit, spans (runs of hit words) and items.

    Null and empty texts have no words; items without words have no windows; an item
    shorter than the window is one window. An item repeated under another id counts for
    both; items without an id are left out. An empty benchmark hits nothing. Documents that
    are repeated are told each; an empty table gives no rows; columns named like those added
    stay inside `doc`.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), text_or_empty(text).alias("text")).filter("item IS NOT NULL")
    pieces = materialise(items.mapInArrow(lambda b: _pieces(b, window), "item string, words binary"), "benchmark")
    size = pieces.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("n")).first().n
    shards = max(1, math.ceil(size / SHARD_BYTES))
    place = docs.columns.index(text)
    out = docs.select(
        F.struct("*").alias("doc"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<struct<first:int,words:int>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for shard in range(shards):
        part = pieces.filter(F.pmod(F.xxhash64("item", "words"), F.lit(shards)) == shard)
        rows = [(r.item, bytes(r.words)) for r in part.collect()]  # about SHARD_BYTES by the sum above
        sent = spark.sparkContext.broadcast(Windows(sorted(rows), window))
        out = out.mapInArrow(lambda b, sent=sent: tidy(_scan(b, sent, place)), out.schema)
        if shard + 1 < shards:
            out = materialise(out, "decontaminate")
    return out


def _scan(batches: Iterable[pa.RecordBatch], sent, place: int) -> Iterator[pa.RecordBatch]:
    windows: Windows = sent.value
    spans_type = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))
    for batch in slices(batches):
        words = [words_of(t) for t in as_bytes(field_or_empty(batch.column(0), place))]
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        ids = np.fromiter(map(windows.vocabulary.get, chain.from_iterable(words), repeat(0)), np.int64, int(ends[-1]) if len(ends) else 0)
        hit = np.zeros(len(ids) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for p, n, found in windows.hits(ids, ends):
            hit[p] += 1
            hit[p + n] -= 1
            items.setdefault(int(np.searchsorted(ends, p, "right")), set()).update(found)
        n_hit, spans, names = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
        covered = np.cumsum(hit) > 0
        for d, found in items.items():
            first = int(ends[d] - sizes[d])
            own = covered[first : ends[d]].copy()
            for s in spans[d]:  # of earlier shards
                own[s["first"] : s["first"] + s["words"]] = True
            edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
            spans[d] = [{"first": int(a), "words": int(b - a)} for a, b in zip(edges[::2], edges[1::2])]
            n_hit[d] = int(own.sum())
            names[d] = sorted({*names[d], *found})
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes), pa.array(n_hit, pa.int64()), pa.array(spans, spans_type), pa.array(names, pa.list_(pa.string()))],
            schema=pa.schema(
                [("doc", batch.schema.field(0).type), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", spans_type), ("items", pa.list_(pa.string()))]
            ),
        )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, as (first word, number of words)."""
    raw, out, at = text.encode(), [], 0
    places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_WORD))]
    for first, n in spans:
        out.append(raw[at : places[first][0]])
        at = places[first + n - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """docs without contaminated documents, or (remove="spans") without the hit words; n_chars,
    where there is one, is then the new text's."""
    found = find(docs, benchmark)
    if remove == "documents":
        return found.filter("n_hit = 0").select("doc.*")

    @F.pandas_udf("string")
    def without(texts, spans):
        return texts.combine(spans, lambda t, s: None if t is None else cut(t, [(x["first"], x["words"]) for x in s]))

    hit = F.col("n_hit") > 0
    cleaned = found.select("doc", hit.alias("hit"), F.when(hit, without("doc.text", "spans")).otherwise(F.col("doc.text")).alias("new_text"))
    columns = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("hit"), F.length("new_text")).otherwise(F.col("doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*(columns.get(c, F.col(f"doc.{c}")).alias(c) for c in docs.columns))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM d, (SELECT DISTINCT n FROM bw) AS ns, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(i)
), hit AS (
  SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, win)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
