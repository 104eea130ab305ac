"""Operator 3: near-duplicates by b-bit MinHash with exact confirmation.

1. Each text becomes its set of 5-word shingles (64-bit hashes), KEYS minima, the low BITS
   bits of each packed into a signature, and BANDS band keys of ROWS minima each.
2. Texts with equal sets are one class; only its smallest document goes on.
3. First round: each document meets the smallest document of each of its band buckets,
   the best by estimated similarity is confirmed on full sets, and links make components.
4. Second round: a bucket that still holds several components is compared in blocks, by
   signatures and set sizes, across components; its largest one is not compared with itself. What this leaves, documents that may be
   linked across components, meets again in blocks with its texts, and links are confirmed
   on full sets there; a pair is looked at in the first bucket that it shares. Tasks return
   documents and joined components, never pairs, so a large group costs its comparisons
   but no rows of their number. No link between components is left out, though pairs
   inside a component need no further look.

A pair of similarity 0.75 shares no bucket with probability (1 - 0.75**4)**32, 5 in a
million; its estimate falls below FLOOR with probability of about 1 in 100,000.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.llm._common import as_bytes, materialise, slices, table, text_or_empty, tidy
from corroba.llm.graph import components

SHINGLE, PERCENT = 5, 75
KEYS, BANDS, ROWS, BITS = 256, 32, 4, 4
#: Estimated similarity from which a pair is confirmed: the threshold less 4.3 standard errors.
FLOOR = 0.63
#: Documents of a bucket that are compared at once: by signatures, and with their texts.
BLOCK, TEXT_BLOCK = 256, 128
_WORDS_KEPT = 150_000
_RNG = np.random.Generator(np.random.PCG64(7))
_XOR = _RNG.integers(0, 1 << 32, KEYS, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 31, KEYS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = _RNG.integers(0, 1 << 63, max(SHINGLE, ROWS) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than a shingle are one."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out += _mixed(h[k : len(h) - n + 1 + k]) * _MIX[k]
    return np.unique(_mixed(out))


def minima(hashes: np.ndarray) -> np.ndarray:
    """KEYS minima of the set under keyed 32-bit permutations."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(KEYS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        y = (x[None, at : at + 2048] ^ _XOR[:, None]) * _MUL[:, None]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(12)
        np.minimum(low, y.min(1), out=low)
    return low


def packed(low: np.ndarray) -> bytes:
    b = (low & np.uint32(15)).astype(np.uint8)
    return (b[::2] | (b[1::2] << 4)).tobytes()


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[ROWS]
    for k in range(ROWS):
        h += _mixed(rows[:, k] + np.uint64(k)) * _MIX[k]
    return _mixed(h).view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of packed signatures (bytes in the last axis), corrected for the chance
    that the low bits of different minima agree."""
    x = a ^ b
    agree = ((x & 15) == 0).sum(-1) + ((x >> 4) == 0).sum(-1)
    chance = 2.0**-BITS
    return (agree / KEYS - chance) / (1 - chance)


SETS = "doc_id long, n_shingles long, set_key binary, signature binary, bands array<long>"


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            s = shingles(text)
            if not len(s) or doc is None:
                rows.append((doc, len(s), None, None, None))
                continue
            low = minima(s)
            rows.append((doc, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), packed(low), band_keys(low)))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        columns = zip(*rows) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "n_shingles", "set_key", "signature", "bands"])


def _estimated(pairs: DataFrame) -> DataFrame:
    """a, b, estimate of pairs (a, b, signature_a, signature_b) from FLOOR on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
            e = estimates(a, b)
            keep = e >= FLOOR
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(e[keep])], names=["a", "b", "estimate"])

    return pairs.select("a", "b", "signature_a", "signature_b").mapInArrow(run, "a long, b long, estimate double")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in slices(batches):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            text_a, text_b = as_bytes(batch.column(2)), as_bytes(batch.column(3))
            keep = []
            for i in range(len(a)):
                if a[i] != last:
                    last, mine = a[i], shingles(text_a[i])
                other = shingles(text_b[i])
                common = len(mine) + len(other) - len(np.union1d(mine, other))
                keep.append(100 * common >= PERCENT * (len(mine) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _candidates(left: list[dict], right: list[dict]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of left the places in right, best first, that may be linked with it, are of
    another component and share no earlier band."""
    size, comp = (np.array([m[k] for m in right], np.int64) for k in ("n", "component"))
    sig = np.frombuffer(b"".join(m["signature"] for m in right), np.uint8).reshape(len(right), -1)
    bands = np.array([m["bands"] for m in right], np.int64)
    for i, m in enumerate(left):
        low, high = np.minimum(size, m["n"]), np.maximum(size, m["n"])
        j = np.flatnonzero((comp != m["component"]) & (100 * low >= PERCENT * high))
        if len(j):
            e = estimates(np.frombuffer(m["signature"], np.uint8), sig[j])
            j, e = j[e >= FLOOR], e[e >= FLOOR]
        if len(j):
            first = (bands[j] == np.array(m["bands"], np.int64)).argmax(1) == m["at"]
            j, e = j[first], e[first]
            yield i, j[np.argsort(-e, kind="stable")]


def _may_link(groups: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a bucket that may be linked across components."""
    for batch in slices(groups, 1):
        row = batch.to_pylist()[0]
        found = set()
        for i, j in _candidates(row["left"], row["right"]):
            if len(j):
                found.add(row["left"][i]["id"])
                found.update(row["right"][k]["id"] for k in j)
        yield pa.RecordBatch.from_arrays([pa.array([row["band"]] * len(found), pa.int64()), pa.array(sorted(found), pa.int64())], names=["band", "id"])


def _joined(groups: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of components that a link between documents of two blocks joins, but for what
    follows from pairs already given."""
    for batch in slices(groups, 1):
        row = batch.to_pylist()[0]
        left, right = row["left"], row["right"]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        sets = [shingles(m["text"].encode()) for m in right]
        out = []
        for i, places in _candidates(left, right):
            mine = shingles(left[i]["text"].encode()) if len(places) else None
            for j in places:
                a, b = find(left[i]["component"]), find(right[j]["component"])
                if a == b:
                    continue
                common = len(mine) + len(sets[j]) - len(np.union1d(mine, sets[j]))
                if 100 * common >= PERCENT * (len(mine) + len(sets[j]) - common):
                    root[max(a, b)] = min(a, b)
                    out.append((left[i]["component"], right[j]["component"]))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])


def _met(members: DataFrame, size: int) -> DataFrame:
    """band, left, right: blocks, of about size documents, of each bucket that has several
    components. members: band and member (with id and component).

    The blocks of a bucket's largest component meet those of its other documents, and these
    meet each other; the largest component never meets itself, so a bucket of copies and a few
    others costs as many pairs as it has blocks.
    """
    sizes = members.groupBy("band", F.col("member.component").alias("component")).agg(F.count("*").alias("n"))
    counted = sizes.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("inside"), F.sum("n").alias("n"), F.count("*").alias("components"))
    blocks = (F.ceil(F.col("inside") / size).cast("int").alias("inside"), F.ceil((F.col("n") - F.col("inside")) / size).cast("int").alias("outside"))
    mixed = materialise(counted.filter("components > 1").select("band", "main", *blocks), "mixed")
    is_main, code = F.col("member.component") == F.col("main"), F.xxhash64("member.id")
    block = F.when(is_main, F.pmod(code, F.col("inside"))).otherwise(F.col("inside") + F.pmod(code, F.col("outside"))).cast("int")
    dealt = members.join(mixed, "band").withColumn("block", block)
    gathered = materialise(dealt.groupBy("band", "inside", "outside", "block").agg(F.collect_list("member").alias("members")), "blocks")
    others = F.sequence(F.when(F.col("block") < F.col("inside"), F.col("inside")).otherwise(0), F.col("inside") + F.col("outside") - 1)
    pairs = F.transform(others, lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    met = gathered.select("band", "block", "members", F.explode(pairs).alias("p")).groupBy("band", "p")
    return met.agg(F.max_by("members", -F.col("block")).alias("left"), F.max_by("members", F.col("block")).alias("right")).select("band", "left", "right")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links), kept.

    Null, empty and blank texts have no shingles, link with nothing and are kept, as are
    rows without an id (component_id null). Rows of one id are one document. Other columns
    are ignored, whatever their names. An empty table gives no rows.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    sets = materialise(given.mapInArrow(lambda b: tidy(_sets(b)), SETS), "sets")
    several = sets.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    several = materialise(several.filter("n > 1").select("set_key", "rep"), "classes")
    classed = sets.join(several, "set_key", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    reps = materialise(classed.filter("set_key IS NOT NULL AND rep = doc_id").select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), "signature", "bands").dropDuplicates(["id"]), "reps")
    keyed = reps.select("id", F.posexplode("bands").alias("at", "band"))
    leaders = materialise(keyed.groupBy("band").agg(F.min("id").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("band", "leader"), "leaders")
    bucketed = materialise(keyed.join(leaders, "band").select("band", "at", "id", "leader"), "bucketed")
    signatures = reps.select("id", "signature")

    stars = materialise(bucketed.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    with_b = stars.join(signatures.toDF("b", "signature_b"), "b")
    estimated = _estimated(with_b.join(signatures.toDF("a", "signature_a"), "a"))
    best = materialise(estimated.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a")).select("a", "b"), "best")
    wanted = materialise(bucketed.select(F.col("id").alias("doc_id")).distinct(), "wanted")
    texts = materialise(given.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).join(wanted, "doc_id", "left_semi"), "texts")
    labels = materialise(components(_confirmed(best, texts)), "labels")

    def labelled(ids: DataFrame, column: str) -> DataFrame:
        known = labels.select(F.col("node").alias(column), F.col("component").alias("found"))
        return ids.join(known, column, "left").withColumn("component", F.coalesce("found", column)).drop("found")

    known_of = F.struct("id", "component", "n", "at", "signature", "bands")
    in_buckets = labelled(bucketed.select("band", "at", "id"), "id").join(reps, "id")
    may = materialise(_met(in_buckets.select("band", known_of.alias("member")), BLOCK).mapInArrow(lambda b: tidy(_may_link(b)), "band long, id long").distinct(), "may")
    chosen = labelled(bucketed.select("band", "at", "id").join(may, ["band", "id"], "left_semi"), "id").join(reps, "id").join(texts.withColumnRenamed("doc_id", "id"), "id")
    with_text = F.struct("id", "component", "n", "at", "signature", "bands", "text")
    joined = materialise(_met(chosen.select("band", with_text.alias("member")), TEXT_BLOCK).mapInArrow(lambda b: tidy(_joined(b)), "a long, b long").distinct(), "joined")
    top = materialise(components(joined), "top").toDF("component", "highest")

    final = labels.join(top, "component", "left").select("node", F.coalesce("highest", "component").alias("component"))
    alone = top.join(labels.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("highest").alias("component"))
    known = materialise(final.union(alone), "components").toDF("rep", "component_id")
    out = classed.select("doc_id", "n_shingles", "rep").join(known, "rep", "left")
    component = F.coalesce("component_id", "rep")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those whose group has a smaller id."""
    gone = materialise(near_duplicates(docs, id_col, text).filter("NOT kept").select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
