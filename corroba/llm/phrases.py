"""Operator 13: phrases that occur together more often than their parts suggest.

Texts are cut at punctuation into pieces and those into words. Each task makes shards of
its texts: an array of word ids, and from it by prefix doubling the suffix array of all places at
which a phrase may begin. Neighbours in that array that agree in n words are an interval, whose
length is how often their n words occur in the shard. These counts are summed by phrase over
all shards.

A phrase of LEAST occurrences has only parts of so many, so the lengths are counted one after
the other: words first, then pairs of frequent words, then longer phrases of frequent pairs.
What is frequent goes to the shards as a bitmap of fixed size by the phrases' hashes. A phrase
that merely shares a bit with a frequent one is counted for nothing; none is left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroba.llm._common import as_bytes, materialise, slices, table, text_or_empty, tidy

#: Occurrences of a candidate and words of the longest; a candidate goes if a longer one has this share of its occurrences.
LEAST, LONGEST, COVERED = 30, 4, 80
#: Phrases that are reported of each language.
REPORTED = 2000
UNKNOWN = "und"
#: Words of a shard, bytes of a text that are cut into words at a time, rows sent at a time.
SHARD_WORDS, TEXT_BYTES, SENT = 2_000_000, 4 << 20, 100_000
#: Bits of the bitmap of what is frequent: 8 MB, however much that is.
BITS = 26
_END = 0xFF  # no byte of UTF-8
_CUT = bytes(_END if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c | 0x20 if 0x41 <= c <= 0x5A else c for c in range(256))


def parts(text: bytes, longest: int = LONGEST) -> Iterator[tuple[list[bytes], int]]:
    """The words of the text with a mark at the end of each piece, TEXT_BYTES at a time, and how many
    words at the end come again first in the next part, so that phrases across it are seen."""
    text, at, held = text.translate(_CUT), 0, []
    while True:
        end = text.find(b" ", at + TEXT_BYTES)
        end = len(text) if end < 0 else end
        words = held + text[at:end].replace(b"\xff", b" \xff ").split()
        if end == len(text):
            yield [*words, b"\xff"], 0
            return
        held = words[-(longest - 1) :] if longest > 1 else []
        yield words, len(held)
        at = end


def _word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang + b"\0" + word)


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = (first ^ (second * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def _in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64((1 << BITS) - 1)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class _Ids(dict):
    """Ids of the words of one language in a shard: 0 ends a piece and stands for words that are not frequent."""

    def __init__(self, shard: "Shard", lang: str):
        super().__init__({b"\xff": 0})
        self.shard, self.lang, self.raw = shard, lang, lang.encode()

    def __missing__(self, word: bytes) -> int:
        return self.shard.meet(self, word)


class Shard:
    """Words of many texts as one array of ids, and the counts of their phrases."""

    def __init__(self, words: np.ndarray | None = None, pairs: np.ndarray | None = None):
        self.frequent_words, self.frequent_pairs = words, pairs
        self.ids: dict[str, _Ids] = {}
        self.words, self.langs, self.hashes = [b""], [""], [0]
        self.arrays, self.tails, self.size = [], [], 0

    def meet(self, ids: _Ids, word: bytes) -> int:
        value, h = len(self.words), _word_hash(ids.raw, word)
        if self.frequent_words is not None:
            place = h & ((1 << BITS) - 1)
            if not self.frequent_words[place >> 3] >> (place & 7) & 1:
                value = 0
        if value:
            self.words.append(word)
            self.langs.append(ids.lang)
            self.hashes.append(h)
        ids[word] = value
        return value

    def add(self, lang: str, words: list[bytes], tail: int) -> None:
        ids = self.ids.get(lang)
        if ids is None:
            ids = self.ids[lang] = _Ids(self, lang)
        self.arrays.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        self.size += len(words)
        if tail:
            self.tails.append(np.arange(self.size - tail, self.size))

    def counts(self, orders: range) -> Iterator[pa.RecordBatch]:
        """lang, phrase, words, n of the phrases of `orders` words."""
        if not self.size:
            return
        beyond = np.zeros(LONGEST, np.int64)
        x = np.concatenate([*self.arrays, beyond])
        self.arrays = []
        n, hashes = self.size, np.array(self.hashes, np.uint64)
        may = {1: x[:n] != 0}  # where a phrase of so many words may begin
        if self.tails:
            may[1][np.concatenate(self.tails)] = False
        if orders[-1] == 1:
            found = np.bincount(x[:n][may[1]], minlength=1)
            ids = np.flatnonzero(found)
            yield from self._rows([ids], found[ids])
            return
        pair = (x[:n] != 0) & (x[1 : n + 1] != 0)
        if self.frequent_pairs is not None:
            at = np.flatnonzero(pair)
            pair[at] = _in_bitmap(self.frequent_pairs, _pair_hashes(hashes[x[at]], hashes[x[at + 1]]))
        pair = np.append(pair, np.zeros(LONGEST, bool))
        for k in range(2, LONGEST + 1):
            may[k] = may[k - 1] & pair[k - 2 : n + k - 2]
        # prefix doubling: places are ranked by one word (the id), two words, four words
        rank, known = x, 1
        while known < orders[-1]:
            step = np.append(rank[known:], np.zeros(known, np.int64))
            key = rank * (int(rank.max()) + 1) + step
            known *= 2
            if known < orders[-1]:
                rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        places = np.flatnonzero(may[orders[0]])
        places = places[np.argsort(key[places])]
        if not len(places):
            return
        agree = np.ones(len(places), bool)  # with the place before, in the words so far
        agree[0] = False
        for k in range(1, orders[-1] + 1):
            agree[1:] &= x[places[1:] + k - 1] == x[places[:-1] + k - 1]
            if k not in orders:
                continue
            first = np.flatnonzero(~agree)
            length = np.diff(np.append(first, len(places)))
            own = may[k][places[first]]  # all places of an interval are alike in this but for tails, which are left out
            first, length = places[first[own]], length[own]
            yield from self._rows([x[first + j] for j in range(k)], length)

    def _rows(self, ids: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        words, langs = pa.array(self.words, pa.binary()), pa.array(self.langs, pa.string()).dictionary_encode()
        for at in range(0, len(n), SENT):
            some = [pa.array(i[at : at + SENT]) for i in ids]
            columns = [words.take(i) for i in some]
            phrase = pc.binary_join_element_wise(*columns, b" ") if len(columns) > 1 else columns[0]
            yield _batch(langs.take(some[0]).cast(pa.string()), phrase.cast(pa.string()), len(ids), n[at : at + SENT])


def _batch(lang: pa.Array, phrase: pa.Array, words: int, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(lang), words, np.int32)), pa.array(n, pa.int64())], names=["lang", "phrase", "words", "n"])


def _shards(batches: Iterable[pa.RecordBatch], orders: range, words: np.ndarray | None, pairs: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    shard, totals = Shard(words, pairs), {}
    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            for some, tail in parts(text, orders[-1]):
                shard.add(lang, some, tail)
                if orders[-1] == 1:
                    totals[lang] = totals.get(lang, 0) + len(some) - some.count(b"\xff")
                if shard.size >= SHARD_WORDS:
                    yield from shard.counts(orders)
                    shard = Shard(words, pairs)
    yield from shard.counts(orders)
    if totals:  # all words of a language stand under no phrase
        yield _batch(pa.array(totals, pa.string()), pa.nulls(len(totals), pa.string()), 0, list(totals.values()))


def _counted(texts: DataFrame, orders: range, least: int, words=None, pairs=None) -> DataFrame:
    """lang, phrase, words, a of the frequent phrases of so many words, and (words 0) all words of each language."""
    found = texts.mapInArrow(lambda b: tidy(_shards(b, orders, words and _bits(words), pairs and _bits(pairs))), "lang string, phrase string, words int, n long")
    return materialise(found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("a")).filter((F.col("a") >= least) | (F.col("words") == 0)), f"phrases-{orders[-1]}")


def _bits(sent) -> np.ndarray:
    return np.frombuffer(sent.value, np.uint8)


def _bitmap(phrases: DataFrame):
    """A broadcast bitmap of the hashes of words or pairs: put together in pieces of 4 KB, so 2**BITS bits in all."""

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, phrase in zip(as_bytes(batch.column(0)), as_bytes(batch.column(1))):
                h = [_word_hash(lang, w) for w in phrase.split(b" ")]
                out.append(h[0] if len(h) == 1 else int(_pair_hashes(np.array(h[:1], np.uint64), np.array(h[1:], np.uint64))[0]))
            yield pa.RecordBatch.from_arrays([pa.array([h & ((1 << BITS) - 1) for h in out], pa.int64())], names=["place"])

    pieces = phrases.select("lang", "phrase").mapInArrow(places, "place long").groupBy(F.shiftright("place", 15).alias("piece")).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(32767))).alias("bits"))
    whole = bytearray(1 << (BITS - 3))
    for r in pieces.collect():
        whole[r.piece * 4096 : r.piece * 4096 + len(r.bits)] = r.bits
    return phrases.sparkSession.sparkContext.broadcast(bytes(whole))


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of all phrases of up to `longest` (at most LONGEST) words that occur
    `least` times or more in a language, and (lang, n): the words of each language."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty(text).alias("text"))
    ones = _counted(texts, range(1, 2), least)
    words, counts = ones.filter("words = 1"), ones.filter("words = 0").select("lang", F.col("a").alias("n"))
    levels = [words]
    if longest > 1:
        sent = _bitmap(words)
        twos = _counted(texts, range(2, 3), least, sent)
        levels.append(twos)
        if longest > 2:
            levels.append(_counted(texts, range(3, longest + 1), least, sent, _bitmap(twos)))
    return reduce(DataFrame.unionByName, levels), counts


def _joined(words, first, count):
    return F.array_join(F.slice(words, first, count), " ")


def uncovered(phrases: DataFrame, covered: int = COVERED) -> DataFrame:
    """Phrases of two words or more that no longer one holds which has `covered` in a hundred of their occurrences."""
    long = phrases.filter("words > 2").select("lang", "a", "words", F.split("phrase", " ").alias("w"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: _joined(F.col("w"), i, k))))
    most = long.select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    wide = lambda c, by: F.lit(by).cast("decimal(3,0)") * F.col(c).cast("decimal(20,0)")
    given = phrases.filter("words > 1").join(most, ["lang", "phrase"], "left")
    return given.filter(F.col("most").isNull() | (wide("most", 100) < wide("a", covered))).drop("most")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, reported: int = REPORTED) -> DataFrame:
    """Of each language the first `reported` phrases: lang, rank, phrase, a (occurrences), l and r
    (those of its parts at the weakest cut), n (words of the language), score.

    Null texts are empty and have no words, a null language is `und`; rows without words, or with less
    than a phrase, only count as words. Repeated rows count each. Ties in score and occurrences go
    by phrase. Texts are cut into parts however long they are. An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    phrases, counts = frequent_phrases(docs, text, lang, least, longest)
    kept = materialise(uncovered(phrases, covered), "uncovered")
    of_parts = phrases.filter(F.col("words") < longest)
    w = F.split("phrase", " ")
    cuts = kept.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", _joined(w, F.lit(1), F.col("cut")).alias("first"), _joined(w, F.col("cut") + 1, F.col("words") - F.col("cut")).alias("rest")
    )
    with_l = materialise(cuts.join(of_parts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"]).drop("first"), "cuts")
    with_r = with_l.join(of_parts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) DIV CAST(l + r AS DECIMAL(20,0))")
    weakest = with_r.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("at"))
    rows = weakest.select("lang", "phrase", "a", "at.*")
    order = (F.desc("score"), F.desc("a"), "phrase")
    for keys in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(32))], ["lang"]):  # a language's phrases are first cut down in 32 groups
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= reported)
    return rows.join(counts, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM w, range(1, 5) AS t(k), unnest(range(1, greatest(len(w) - k + 1, 0) + 1)) AS u(i)
  GROUP BY ALL HAVING count(*) >= 30
), c AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), inner_of AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most
  FROM c, range(2, 4) AS t(m), unnest(range(1, k - m + 2)) AS u(i) WHERE m < k GROUP BY ALL
), kept AS (
  SELECT c.* FROM c LEFT JOIN inner_of USING (lang, phrase) WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT)
), cuts AS (
  SELECT kept.lang, kept.phrase, kept.a, cut, x.a AS l, y.a AS r, CAST(2000000 * CAST(kept.a AS HUGEINT) // (x.a + y.a) AS BIGINT) AS score
  FROM kept, unnest(range(1, kept.k)) AS t(cut)
  JOIN f AS x ON x.lang = kept.lang AND x.phrase = array_to_string(kept.w[1:cut], ' ')
  JOIN f AS y ON y.lang = kept.lang AND y.phrase = array_to_string(kept.w[cut + 1:kept.k], ' ')
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest
) JOIN totals USING (lang) WHERE rank <= 2000
"""
