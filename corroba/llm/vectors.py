"""Operator 10: embedding near-duplicates by product quantisation.

Coarse centroids (k-means on a bounded sample) split the vectors into inverted lists; what a
centroid leaves is coded by SUBSPACES codes of 256 codewords. A vector is compared with every
list that can hold a link: list borders are hyperplanes, and a link reaches past one by at most
its own length; a list further off than its radius and that length is left out as well. Table
lookups give the distance to the coded vectors, and as each code's own error is kept, no linked
vector is passed over: the triangle inequality bounds the true distance from below. What remains
is ranked again by the exact cosine in double precision. Lists that lie wholly within reach of a
vector are counted by weight, without comparing. Equal vectors are one class with a weight.
Lists are broadcast in shards of bounded size and every task compares its rows with a shard; it
returns counts and a spanning forest, not its pairs. So a hot group neither skews nor shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from corroba.llm._common import materialise, slices, table
from corroba.llm.graph import components

COSINE = 0.95
#: Vectors that centroids and codewords are fitted on, at most about.
SAMPLE = 20_000
LIST_SIZE, MAX_LISTS, SUBSPACES, CODEWORDS = 128, 4096, 8, 256
#: Bytes of the vectors of a broadcast shard, about.
SHARD_BYTES = 16 << 20
#: Rows, and members of a list, that are compared at a time.
ROWS, MEMBERS = 1024, 1024


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    half = (centres**2).sum(1) / 2
    for at in range(0, len(x), 2048):
        out[at : at + 2048] = (half - np.einsum("ij,kj->ik", x[at : at + 2048], centres, optimize=True)).argmin(1)
    return out


def k_means(x: np.ndarray, k: int, turns: int = 6) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(11))
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(turns):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


class Quantiser:
    """Coarse centroids and, for each subspace, codewords of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = k_means(sample, lists)
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.words = [k_means(np.ascontiguousarray(rest[:, a:b]), CODEWORDS) for a, b in zip(self.cuts, self.cuts[1:])]

    def squares(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Squared distances of vectors from the centres of some lists."""
        centres = self.centres[lists]
        return np.maximum(0, (x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * (x @ centres.T))

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the distance of each vector from what its code stands for."""
        rest = x - self.centres[lists]
        codes = np.stack([_nearest(rest[:, a:b], w) for a, b, w in zip(self.cuts, self.cuts[1:], self.words)], 1).astype(np.uint8)
        stands = np.concatenate([w[codes[:, s]] for s, w in enumerate(self.words)], 1)
        return codes, np.sqrt(((rest - stands) ** 2).sum(1))

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        """For each subspace: the product of each codeword with each vector's part."""
        return [(w @ x[:, a:b].T).astype(np.float32) for w, a, b in zip(self.words, self.cuts, self.cuts[1:])]

    def offsets(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What a coded vector of a list adds to the squared distance from the list's centre."""
        stands = np.concatenate([w[codes[:, s]] for s, w in enumerate(self.words)], 1)
        return (stands**2 + 2 * self.centres[lists] * stands).sum(1)


def _unit(raw: list[bytes], kind: str = "<f8") -> np.ndarray:
    """Unit vectors; scaled by their largest component first, so that no square overflows."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the links left - right."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at[: len(left)], at[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


class Shard:
    """Members of some lists, sorted by list, and what comparing rows with them found so far.

    Each pair of vectors is compared once: by the row of the lower list, or in one list by the
    lower id.
    """

    def __init__(self, quantiser: Quantiser, members: pa.Table, kind: str, cosine: float):
        self.q, self.cosine, self.reach = quantiser, cosine, float(np.sqrt(2 - 2 * cosine)) + 1e-6
        home = members["home"].to_numpy()
        order = np.lexsort((members["id"].to_numpy(), home))
        home, self.id, self.weight, error = home[order], *(members[c].to_numpy()[order] for c in ("id", "weight", "error"))
        raw, codes = members["vector"].to_pylist(), members["codes"].to_pylist()
        self.y = _unit([raw[i] for i in order], kind)
        self.codes = np.frombuffer(b"".join(codes[i] for i in order), np.uint8).reshape(len(order), -1)
        self.offset = self.q.offsets(home, self.codes).astype(np.float32)
        # squares are compared in single precision, hence the margin
        self.limit = ((self.reach + error) ** 2 + 1e-4).astype(np.float32)
        self.lists, starts = np.unique(home, return_index=True)
        self.ends = np.append(starts, len(home))
        self.radius = np.sqrt(np.maximum.reduceat(((self.y - self.q.centres[home]) ** 2).sum(1), starts)) + 1e-9
        self.apart = np.sqrt(self.q.squares(self.q.centres, self.lists))
        self.links, self.label = np.zeros(len(home), np.int64), self.id.copy()

    def compare(self, x: np.ndarray, ids: np.ndarray, weights: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Links of the rows; those of the members are added up here. Also the links' forest."""
        links, label, edges = np.zeros(len(x), np.int64), ids.copy(), []
        far, tables = self.q.squares(x, self.lists), self.q.tables(x)
        own = ((x - self.q.centres[home]) ** 2).sum(1)
        near = (far - own[:, None] <= 2 * self.reach * self.apart[home] + 1e-9) & (np.sqrt(far) <= self.radius + self.reach) & (home[:, None] <= self.lists)
        whole = near & (np.sqrt(far) + self.radius + 2e-6 <= self.reach) & (home[:, None] < self.lists)
        near &= ~whole

        def link(i: np.ndarray, j: np.ndarray) -> None:
            a, b = label[i], self.label[j]
            apart = a != b
            if apart.any():
                node, root = _forest(a[apart], b[apart])
                edges.append((node, root))
                for labels in (label, self.label):
                    at = np.minimum(np.searchsorted(node, labels), len(node) - 1)
                    labels[:] = np.where(node[at] == labels, root[at], labels)

        for place, one in enumerate(self.lists):
            low, high = self.ends[place], self.ends[place + 1]
            rows = np.flatnonzero(whole[:, place])
            if len(rows):
                links[rows] += self.weight[low:high].sum()
                self.links[low:high] += weights[rows].sum()
                link(np.concatenate([rows, np.full(high - low, rows[0])]), np.concatenate([np.full(len(rows), low), np.arange(low, high)]))
            rows = np.flatnonzero(near[:, place])
            if not len(rows):
                continue
            some = 3 * len(rows) < len(x)
            used = [t[:, rows] for t in tables] if some else tables
            for at in range(low, high, MEMBERS):
                held = slice(at, min(at + MEMBERS, high))
                products = sum(t[self.codes[held, s]] for s, t in enumerate(used))
                if not some:
                    products = products[:, rows]
                may = (far[rows, place].astype(np.float32) + self.offset[held, None] - 2 * products) <= self.limit[held, None]
                j, i = np.nonzero(may)
                if not len(i):
                    continue
                if 8 * len(i) > may.size:
                    exact = (self.y[held] @ x[rows].T)[j, i]
                    edge = np.flatnonzero(np.abs(exact - self.cosine) < 1e-9)
                    exact[edge] = np.einsum("ij,ij->i", x[rows[i[edge]]], self.y[at + j[edge]])
                else:
                    exact = np.einsum("ij,ij->i", x[rows[i]], self.y[at + j])
                keep = exact >= self.cosine
                i, j = rows[i[keep]], at + j[keep]
                same = (home[i] != one) | (ids[i] < self.id[j])
                i, j = i[same], j[same]
                links += np.bincount(i, self.weight[j], len(x)).astype(np.int64)
                self.links += np.bincount(j, weights[i], len(self.id)).astype(np.int64)
                link(i, j)
        return links, edges


def _told(ids: np.ndarray, links: np.ndarray, edges: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of id, links, root: the links counted, then the edges of the forest."""
    some = np.flatnonzero(links)
    node, root = (np.concatenate([ids[:0], *(e[k] for e in edges)]) for k in (0, 1))
    columns = np.concatenate([ids[some], node]), np.concatenate([links[some], np.zeros(len(node), np.int64)]), np.concatenate([ids[some], root])
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "links", "root"])


def _shards(sizes: pa.Table, most: int) -> Iterator[tuple[int, int, int, int]]:
    """(first list, last list, piece, pieces) of shards of about `most` members; a longer list is cut by id."""
    held: list[int] = []
    n = 0
    for one, size in zip(sizes["home"].to_pylist(), sizes["count"].to_pylist()):
        if held and n + size > most:
            yield held[0], held[-1], 0, 1
            held, n = [], 0
        if size > most:
            pieces = -(-size // most)
            yield from ((one, one, piece, pieces) for piece in range(pieces))
            continue
        held.append(one)
        n += size
    if held:
        yield held[0], held[-1], 0, 1


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Per row: vec_id, n_links (rows directly linked, itself left out), component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; vectors are compared with those of their own length, one length after another.
    Equal vectors link with each other, as do those that differ by a factor. Rows of one id are
    counted each and share a component; rows without an id link with nothing. Other columns
    are ignored, whatever their names; an empty table gives no rows.
    """
    # vectors given in single precision are kept so: nothing is lost
    kind = "<f4" if vectors.schema[column].dataType.elementType == FloatType() else "<f8"
    number = F.transform(column, lambda x: x.cast("double"))
    sound = F.coalesce(F.exists(number, lambda x: x != 0) & F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    given = materialise(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(sound, number).alias("v")), "vectors")
    usable = given.filter("v IS NOT NULL AND vec_id IS NOT NULL").withColumn("d", F.size("v"))
    lengths = [r.d for r in usable.groupBy("d").agg(F.count("*").alias("n")).filter("n > 1").orderBy("d").collect()]
    linked = [_linked(usable.filter(F.col("d") == d).drop("d"), d, kind, cosine) for d in lengths]
    compared = F.coalesce(F.size("v").isin(lengths) & F.col("vec_id").isNotNull(), F.lit(False)) if lengths else F.lit(False)
    out = given.filter(~compared).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for part in linked:
        out = out.union(part)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _linked(usable: DataFrame, d: int, kind: str, cosine: float) -> DataFrame:
    """vec_id, n_links, component_id of sound vectors (vec_id, v) of length d."""
    spark = usable.sparkSession
    # a vector's bytes are its key; -0.0 counts as 0.0
    key = F.sha2(F.array_join(F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")), ","), 256)
    keyed = materialise(usable.select("vec_id", key.alias("key"), "v"), "keyed")
    classes = keyed.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    classes = materialise(classes, "classes")
    n = classes.count()
    single = materialise(keyed.join(classes, "key").filter("vec_id = id").dropDuplicates(["id"]).select("id", "weight", "v"), "single")

    rows = single.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < min(1.0, SAMPLE / n) * (1 << 20)).select("v").toPandas()["v"]
    if not len(rows):
        rows = [r.v for r in single.select("v").limit(1).collect()]
    sample = _unit([np.asarray(r, np.float64).tobytes() for r in rows])
    quantiser = spark.sparkContext.broadcast(Quantiser(sample, int(min(MAX_LISTS, max(1, n // LIST_SIZE)))))

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = quantiser.value
        for batch in slices(batches, 1024):
            if not batch.num_rows:
                continue
            raw = [np.asarray(v, np.float64) for v in batch.column(2).to_pylist()]
            x = _unit([v.tobytes() for v in raw])
            home = _nearest(x, q.centres)
            codes, error = q.encode(x, home)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([v.astype(kind).tobytes() for v in raw], pa.binary()), pa.array(home, pa.int32()),
                    pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error),
                ],
                names=["id", "weight", "vector", "home", "codes", "error"],
            )

    indexed = single.mapInArrow(index, "id long, weight long, vector binary, home int, codes binary, error double")
    # rows of every list in every part, so that tasks have the same to compare
    parts = max(2 * spark.sparkContext.defaultParallelism, n // 20_000)
    indexed = materialise(indexed.repartition(parts, "id").sortWithinPartitions("home", "id"), "indexed")
    most = max(1, SHARD_BYTES // (d * np.dtype(kind).itemsize))
    found = None
    for first, last, piece, pieces in _shards(indexed.groupBy("home").count().orderBy("home").toArrow(), most):
        members = indexed.filter(F.col("home").between(first, last) & (F.pmod(F.xxhash64("id"), F.lit(pieces)) == piece)).toArrow()
        if not members.num_rows:
            continue
        sent = spark.sparkContext.broadcast(members)

        def compare(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            shard = Shard(quantiser.value, sent.value, kind, cosine)
            for batch in slices(batches, ROWS):
                if not batch.num_rows:
                    continue
                ids, weights, home = (batch.column(c).to_numpy() for c in (0, 1, 3))
                links, edges = shard.compare(_unit(batch.column(2).to_pylist(), kind), ids, weights, home)
                yield _told(ids, links, edges)
            yield _told(shard.id, shard.links, [])

        part = materialise(indexed.filter(F.col("home") <= last).select("id", "weight", "vector", "home").mapInArrow(compare, "id long, links long, root long"), "found")
        found = part if found is None else found.union(part)
        sent.destroy()
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).toDF("id", "component")
    known = classes.join(counts, "id", "left").join(labels, "id", "left")
    known = materialise(known.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "known")
    return keyed.select("vec_id", "key").join(known, "key").select("vec_id", "n_links", "component_id")


def op10_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
    AND list_dot_product(list_transform(a.e, lambda x: x / a.n), list_transform(b.e, lambda x: x / b.n)) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
), low AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM pairs GROUP BY a
)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN low ON low.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
