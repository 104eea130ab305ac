"""Operator 12: importance resampling towards a target distribution.

1. Each task adds up, in one array a corpus, how many of its features fall into each hash
   bucket; the arrays' sums give every bucket's gain, an array of BUCKETS integers.
2. Each document's weight is the floored mean of its features' gains, looked up in that array;
   noise by a digest of its id makes the weight an integer score.
3. The histogram of the scores, of which there are few whatever the corpus, is summed from
   its top: so the cutoff score and the rank of each score's first document are known.
4. Only documents from the cutoff on are ranked, each score by itself.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroba.llm._common import as_bytes, materialise, slices, table, text_or_empty, tidy
from corroba.llm.decontaminate import words_of

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
#: Documents of fewer words are never drawn; of the others so many in a hundred are.
LEAST_WORDS, PERCENT = 20, 10
_WORDS_KEPT = 300_000


class _Checksums(dict):
    """crc32 of words; those of a task's latest texts are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = zlib.crc32(word)
        return value


def features(words: list[bytes], longest: int, known: _Checksums) -> list[np.ndarray]:
    """Checksums of the runs of 1 to `longest` words, an array a length."""
    out = [np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
    for n in range(2, longest + 1):
        out.append(np.fromiter((zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)), np.int64, max(0, len(words) - n + 1)))
    return out


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sends no more than its array."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Checksums(), np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for raw in as_bytes(batch.column(0)):
                for sums in features(words_of(raw), longest, known):
                    total += np.bincount(sums % buckets, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    given = texts.select(text_or_empty(text).alias("text"))
    for r in given.mapInArrow(lambda b: tidy(count(b)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Each bucket's floored, scaled log-ratio of its add-one shares of target and source."""
    s_all, t_all = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(scale * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id, seed: int = SEED, scale: int = 1000) -> int:
    """A Gumbel number by the id, floored; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_words, n_features, weight, score."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, known = sent.value, _Checksums()
        for batch in slices(batches):
            ids, n_words, n_features, weight = batch.column(0).to_pylist(), [], [], []
            for raw in as_bytes(batch.column(1)):
                words = words_of(raw)
                all_sums = features(words, longest, known)
                n = sum(map(len, all_sums))
                n_words.append(len(words))
                n_features.append(n)
                weight.append(sum(int(of[sums % len(of)].sum()) for sums in all_sums) // n if n else 0)
            score = [w + noise(i, seed) for i, w in zip(ids, weight)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight, score))], names=["id", "n_words", "n_features", "weight", "score"])

    given = docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return given.mapInArrow(lambda b: tidy(run(b)), f"id {kind}, n_words long, n_features long, weight long, score long")


def cutoff(histogram: list[tuple[int, int]], wanted: int) -> list[tuple[int, int]]:
    """(score, documents above it) of each score that is drawn from, best first.
    histogram: (score, documents)."""
    out, above = [], 0
    for score, n in sorted(histogram, reverse=True):
        if above >= wanted:
            break
        out.append((score, above))
        above += n
    return out


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: id, n_features, weight, score and rank, null for what is not drawn.

    Of the N rows of at least `least_words` words, floor(percent * N / 100) are drawn: the highest
    scores, ties by the smaller id, then (rows of one id) by fewer features. Rows that are equal
    in all this get ranks one after the other. A null id counts as an empty one for the noise
    and goes before all others in a tie. Null and empty texts have no features, weight 0, and are
    never drawn unless `least_words` is 0. An empty target makes rare features heavy; an empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, text, longest, buckets))
    rows = materialise(scored(docs, gain, longest, seed, id_col, text), "scores")
    may = F.col("n_words") >= least_words
    # A gain lies within +-1000 * ln(2**64 * buckets) and the noise within -3,200 and 22,900: some 100,000 scores at most.
    histogram = [(r.score, r.n) for r in rows.filter(may).groupBy("score").agg(F.count("*").alias("n")).collect()]
    wanted = percent * sum(n for _, n in histogram) // 100
    firsts = cutoff(histogram, wanted)
    lowest = firsts[-1][0] if firsts else None
    drawn = may & (F.col("score") >= F.lit(lowest)) if firsts else F.lit(False)
    others = rows.filter(~drawn).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if firsts:
        above = F.broadcast(spark.createDataFrame(firsts, "score long, above long"))
        # equal rows are one with a number until they are ranked: a row repeated very often is one
        equal = rows.filter(drawn).groupBy("score", "id", "n_features", "weight").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("score").orderBy(F.asc_nulls_first("id"), "n_features").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = equal.withColumn("upto", upto).join(above, "score")
        each = placed.select("id", "n_features", "weight", "score", F.explode(F.sequence(F.col("above") + F.col("upto") - F.col("n") + 1, F.col("above") + F.col("upto"))).alias("rank"))
        others = others.unionByName(each.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))))
    return others.withColumnRenamed("id", id_col)


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **parameters) -> DataFrame:
    """The rows of docs that are drawn, as they are; rows of one id are drawn together."""
    drawn = materialise(resample(docs, target, id_col, **parameters).filter("rank IS NOT NULL").select(id_col).distinct(), "drawn")
    return docs.join(drawn.withColumnRenamed(id_col, "_drawn"), F.col(id_col).eqNullSafe(F.col("_drawn")), "left_semi")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH RECURSIVE bits(v, c, k) AS (
  SELECT CAST(v AS BIGINT), CAST(v AS BIGINT), 0 FROM range(256) AS r(v)
  UNION ALL
  SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), steps AS (
  SELECT list(c ORDER BY v) AS step FROM bits WHERE k = 8
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), dw AS (
  SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY ALL
), bw AS (
  SELECT w, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY w
), bytes AS (
  SELECT w, CAST('0x' || substr(hex(encode(w)), 2 * i - 1, 2) AS BIGINT) AS b, i
  FROM (SELECT w FROM dw UNION SELECT w FROM bw), unnest(range(1, strlen(w) + 1)) AS t(i)
), bucket AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list(b ORDER BY i)), lambda c, b: xor(step[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS k
  FROM bytes, steps GROUP BY w, step
), source AS (
  SELECT k, CAST(sum(n) AS BIGINT) AS s FROM dw JOIN bucket USING (w) GROUP BY k
), target AS (
  SELECT k, CAST(sum(n) AS BIGINT) AS t FROM bw JOIN bucket USING (w) GROUP BY k
), totals AS (
  SELECT coalesce((SELECT sum(s) FROM source), 0) + 10000 AS s_all, coalesce((SELECT sum(t) FROM target), 0) + 10000 AS t_all
), gain AS (
  SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * CAST(s_all AS DOUBLE) / ((coalesce(s, 0) + 1.0::DOUBLE) * CAST(t_all AS DOUBLE)))) AS BIGINT) AS g
  FROM source FULL JOIN target USING (k), totals
), weighed AS (
  SELECT doc_id, sum(n) AS n_features, CAST(floor(sum(n * g)::DOUBLE / sum(n)) AS BIGINT) AS weight
  FROM dw JOIN bucket USING (w) JOIN gain USING (k) GROUP BY doc_id
), noisy AS (
  SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents LEFT JOIN weighed USING (doc_id)
), ranked AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM noisy
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM noisy WHERE n_features >= 20) * 10 // 100 THEN place END AS rank
FROM ranked
"""
