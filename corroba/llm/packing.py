"""Operator 5: packing documents into sequences by cutting-stock column generation.

Documents longer than a sequence give whole sequences and a rest. The rests' lengths,
in classes of UNIT tokens, are a cutting-stock problem: a linear program over patterns
(how many rests of each class fill one sequence) whose columns a knapsack priced with the
program's duals generates. Rounded-down patterns are then dealt to documents by rank within
their class; what rounding leaves is packed first-fit on the histogram. Only histograms
reach the driver (2048 / UNIT classes); ranks come from counts per task and class, so no
class, however frequent, meets in one task.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroba.llm._common import materialise, slices, table, text_or_empty
from corroba.llm.tokens import part_cache, tokenizer_path

SEQUENCE, UNIT, END_ID = 2048, 8, 1
#: Column generation warns and ends here; a few hundred columns are enough for 256 classes. What is
#: then not optimal is still a packing of all pieces.
MAX_COLUMNS = 20_000


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the best value of a pattern and its number of each class."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    sizes_up, values_up = sizes[order], values[order]
    for c in range(1, capacity + 1):
        k = np.searchsorted(sizes_up, c, "right")
        best[c] = best[c - 1]
        if k:
            gain = best[c - sizes_up[:k]] + values_up[:k]
            j = int(gain.argmax())
            if gain[j] > best[c] + 1e-12:
                best[c], last[c] = gain[j], order[j]
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[capacity]), pattern


def invert(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination, for matrices of a few hundred rows; it starts no threads."""
    m = len(matrix)
    both = np.hstack([matrix, np.eye(m)])
    for i in range(m):
        pivot = i + int(np.abs(both[i:, i]).argmax())
        both[[i, pivot]] = both[[pivot, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0
        both -= factor[:, None] * both[i]
    return both[:, m:]


def column_generation(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """(pattern, times used) of the linear program: fewest sequences that hold all counts.

    The revised simplex method: the basis has one pattern a class; its inverse gives the
    duals. It starts from first-fit decreasing in fractions: each of its patterns uses up
    a class that no later pattern has, so the basis is triangular and its use not negative.
    """
    m = len(sizes)
    basis = np.zeros((m, m))
    left, done = counts.astype(float), np.zeros(m, bool)
    while not done.all():
        pattern, room = np.zeros(m, np.int64), capacity
        for j in np.flatnonzero(~done)[::-1]:
            pattern[j] = min(room // sizes[j], int(np.ceil(left[j])))
            room -= int(pattern[j] * sizes[j])
        inside = np.flatnonzero(pattern)
        times = left[inside] / pattern[inside]
        out = inside[times.argmin()]
        left[inside] -= times.min() * pattern[inside]
        basis[:, out] = pattern
        done[out] = True
        for j in inside[(left[inside] < 1e-9) & ~done[inside]]:  # used up at the same time
            basis[j, j] = capacity // sizes[j]
            done[j] = True
    inverse = invert(basis)
    used = np.maximum(0, (inverse * counts).sum(1))
    for turn in range(MAX_COLUMNS):
        duals = inverse.sum(0)
        value, pattern = price(np.maximum(duals, 0), sizes, capacity)
        if value <= 1 + 1e-7:
            break
        step = (inverse * pattern).sum(1)
        ratio = np.full(m, np.inf)
        up = step > 1e-9
        ratio[up] = used[up] / step[up]
        out = int(ratio.argmin())
        basis[:, out] = pattern
        if turn % 500 == 499:
            inverse = invert(basis)
        else:
            row = inverse[out] / step[out]
            inverse = inverse - np.outer(step, row)
            inverse[out] = row
        used = np.maximum(0, (inverse * counts).sum(1))
    else:
        warnings.warn("column generation ended before the optimum; the packing is whole, but not the tightest", stacklevel=2)
    return [(basis[:, j].astype(np.int64), float(used[j])) for j in range(m)]


def plan_patterns(histogram: dict[int, int], capacity: int = SEQUENCE // UNIT) -> list[tuple[dict[int, int], int]]:
    """(class -> number, sequences) so that every class's count is used exactly.

    histogram: class (length in units, 1 to capacity) -> count."""
    left = {c: n for c, n in histogram.items() if n}
    plan: list[tuple[dict[int, int], int]] = []
    if left:
        sizes = np.array(sorted(left))
        counts = np.array([left[int(c)] for c in sizes])
        for pattern, times in sorted(column_generation(sizes, counts, capacity), key=lambda x: -x[1]):
            items = {int(c): int(k) for c, k in zip(sizes, pattern) if k}
            n = min([int(times + 1e-9), *(left[c] // k for c, k in items.items())])
            if n > 0 and items:
                plan.append((items, n))
                for c, k in items.items():
                    left[c] -= k * n
    while any(left.values()):  # first-fit decreasing, as many equal sequences at once as there are
        items, room = {}, capacity
        for c in sorted((c for c, n in left.items() if n), reverse=True):
            k = min(left[c], room // c)
            if k:
                items[c] = k
                room -= k * c
        n = min(left[c] // k for c, k in items.items())
        plan.append((items, n))
        for c, k in items.items():
            left[c] -= k * n
    return plan


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, task int, in_task long"


def pieces_of(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece; in_task counts the pieces of a class within a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, task, seen = part_cache(path, "ids"), TaskContext.get().partitionId(), np.zeros(SEQUENCE // UNIT + 1, np.int64)
        for batch in slices(batches):
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), cache.ids(batch.column(1).to_pylist())):
                ids = np.append(np.frombuffer(raw, "<u2").astype("<u4"), np.uint32(END_ID)).astype("<u4")
                for at in range(0, len(ids), SEQUENCE):
                    piece = ids[at : at + SEQUENCE]
                    c = -(-len(piece) // UNIT)
                    rows.append((doc, at, len(piece), zlib.crc32(piece.tobytes()), len(ids), c, task, int(seen[c])))
                    seen[c] += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            columns = zip(*rows) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone: one piece of length 1. Repeated rows are
    packed each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = materialise(pieces_of(docs, path, id_col, text), "pieces")
    per_task = pieces.groupBy("class", "task").agg(F.count("*").alias("n"))
    histogram = {r["class"]: r.n for r in per_task.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    # slots: of each class, the ranks from `first` on go to a pattern's sequences from `base` on, `k` to each
    slots, base, taken = [], 0, dict.fromkeys(histogram, 0)
    for items, n in plan_patterns(histogram):
        for c, k in items.items():
            slots.append((c, taken[c], taken[c] + k * n, base, k))
            taken[c] += k * n
        base += n
    by_class = {c: sorted(s[1:] for s in slots if s[0] == c) for c in histogram}
    sent = spark.sparkContext.broadcast({c: np.array(x, np.int64).reshape(-1, 4) for c, x in by_class.items()})

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            sequence = np.zeros(len(c), np.int64)
            for one in np.unique(c):
                at = np.flatnonzero(c == one)
                s = sent.value[int(one)]
                row = s[np.searchsorted(s[:, 0], rank[at], "right") - 1]
                sequence[at] = row[:, 2] + (rank[at] - row[:, 0]) // row[:, 3]
            columns = [batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence, pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
            )

    before = per_task.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("task")) - F.col("n")).drop("n")
    dealt = (
        pieces.join(before, ["class", "task"])
        .withColumn("rank", F.col("before") + F.col("in_task"))
        .mapInArrow(deal, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long")
    )
    # a sequence has at most SEQUENCE pieces
    place = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")
    return dealt.withColumn("offset", F.sum("length").over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
