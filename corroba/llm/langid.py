"""Operator 2: language identification by Kneser-Ney character models.

For each learned language an interpolated Kneser-Ney model of order ORDER over the letters
of a word (contexts begin at the word's start). Grams and contexts of all languages lie in
sorted hash arrays, each with the languages that have it and their values, and are broadcast. A text goes to the language
of lowest cross-entropy a character; a limit calibrated on labelled texts that no count
saw rejects texts that no model explains.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.llm._common import crc_mod, field_or_empty, slices, small_batches, table, text_or_empty, tidy

ORDER = 4
#: Labelled texts that are learned from, about so many a language: the model's size depends on it alone.
TRAIN_TEXTS = 1000
#: Of these, one in CALIBRATE is kept from the counts to set the limits of rejection.
CALIBRATE = 5
#: The limit is this quantile of the cross-entropy of kept texts, times the slack.
QUANTILE, SLACK = 0.995, 1.3
#: Bits by which a whole text must exceed its limit: short texts are not rejected for a rare word.
SURPLUS = 40.0
#: Characters beyond which more text makes the posterior no sharper.
SHARPEST = 40
UNDETERMINED = "und"
_WORDS_KEPT = 300_000
_LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_START, _END = "\x02" * (ORDER - 1), " "


def words_of(text: str) -> list[bytes]:
    """Runs of a-z and non-ASCII characters of the lower-cased text."""
    return text.lower().encode().translate(_LETTERS).split()


def has_letter(text: str, words: list[bytes]) -> bool:
    return bool(words) and (text.isascii() or any(map(str.isalpha, text)))


def _codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The padded words' characters, the places of those to score (a word's end is one), and
    how many each word has."""
    padded = [f"{_START}{w.decode(errors='replace')}{_END}" for w in words]
    sizes = np.array([len(p) - ORDER + 1 for p in padded], np.int64)
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes + ORDER - 1) - sizes - ORDER + 1
    own = np.ones(len(codes), bool)
    for k in range(ORDER - 1):
        own[starts + k] = False
    return codes, np.flatnonzero(own), sizes


def _back(codes: np.ndarray, at: np.ndarray, first: int, n: int) -> list[np.ndarray]:
    """Hashes of the 1 to n characters that end `first` places before each place."""
    out, h = [], np.zeros(len(at), np.uint64)
    for k in range(first, first + n):
        h = (h + codes[at - k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out.append(h)
    return out


class Models:
    """Sorted hash arrays: of grams with their discounted probabilities, of contexts with
    the weight of the shorter context."""

    def __init__(self, languages: list[str], counts: dict[str, Counter]):
        self.languages = languages
        self.grams, self.contexts, self.limits = [], [], {}
        per_order: list[list[dict]] = []
        for lang in languages:
            level = counts[lang]  # of the highest order: how often; below: after how many characters
            orders = []
            for order in range(ORDER, 0, -1):
                total, kinds = Counter(), Counter()
                for gram, c in level.items():
                    total[gram[:-1]] += c
                    kinds[gram[:-1]] += 1
                ones, twos = sum(c == 1 for c in level.values()), sum(c == 2 for c in level.values())
                d = ones / (ones + 2 * twos) if ones and twos else 0.75
                orders.append(({g: max(0.0, c - d) / total[g[:-1]] for g, c in level.items()}, {h: d * kinds[h] / total[h] for h in total}))
                level = Counter(g[1:] for g in level)
            per_order.append(orders[::-1])
        letters = {g for orders in per_order for g in orders[0][0]}
        self.floor = 1.0 / (len(letters) + 1000)  # a uniform share for letters that no text had
        for k in range(ORDER):
            for store, part, empty in ((self.grams, 0, 0.0), (self.contexts, 1, 1.0)):
                entries = [(_hash(g), lang, v) for lang, orders in enumerate(per_order) for g, v in orders[k][part].items()]
                hashes, langs, values = (np.array([e[i] for e in entries], t) for i, t in enumerate((np.uint64, np.int32, np.float32)))
                order = np.argsort(hashes, kind="stable")
                hashes, first = np.unique(hashes[order], return_index=True)
                first, langs, values = np.append(first, len(entries)), langs[order], values[order]
                rows = None
                if len(hashes) * len(languages) <= 4 * len(entries):  # few languages: whole rows take little more and are found faster
                    rows = np.full((len(hashes) + 1, len(languages)), empty, np.float32)  # the last row is that of unknown keys
                    rows[np.repeat(np.arange(len(hashes)), np.diff(first)), langs] = values
                    first = langs = values = None
                store.append((hashes, rows, first, langs, values, empty))

    def score(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """log2-probabilities of the words by each language, and their numbers of characters."""
        codes, at, sizes = _codes(words)
        hashes = _back(codes, at, 0, ORDER)
        before = [np.zeros(len(at), np.uint64), *_back(codes, at, 1, ORDER - 1)]
        p = np.full((len(at), len(self.languages)), self.floor, np.float32)
        for k in range(ORDER):
            p *= self._spread(self.contexts[k], before[k])
            p += self._spread(self.grams[k], hashes[k])
        starts = np.cumsum(sizes) - sizes
        return np.add.reduceat(np.log2(np.maximum(p, 1e-12)), starts, 0), sizes

    def _spread(self, store: tuple, keys: np.ndarray) -> np.ndarray:
        """A row of each key with a value a language, `empty` where a language doesn't have it."""
        hashes, whole, first, langs, values, empty = store
        at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        if whole is not None:
            return whole[np.where(hashes[at] == keys, at, len(hashes))]
        rows = np.flatnonzero(hashes[at] == keys)
        at = at[rows]
        n = first[at + 1] - first[at]
        entries = np.arange(int(n.sum())) + np.repeat(first[at] - np.cumsum(n) + n, n)
        out = np.full((len(keys), len(self.languages)), empty, np.float32)
        out[np.repeat(rows, n), langs[entries]] = values[entries]
        return out


def _hash(gram: str) -> int:
    h = 0
    for c in reversed(gram):
        h = (h + ord(c) + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return h


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang", train_texts: int = TRAIN_TEXTS) -> Models | None:
    """Models of the languages of the usable rows with a language: about train_texts whole
    texts of each, by a hash of the id, are learned from. None if no row is usable. A language
    of which no kept text was told right takes the limit of all; without any, no text is rejected."""
    small_batches(docs.sparkSession)
    labelled = docs.filter(usable & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), text_or_empty(text).alias("text"), F.xxhash64(F.col(id_col), F.lit(20)).alias("h"))
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, train_texts / n))) for k, n in sizes.items()))
    sample = labelled.filter(F.pmod(F.col("h"), F.lit(1 << 20)) < share * (1 << 20)).withColumn("kept", F.pmod(F.shiftright("h", 20), F.lit(CALIBRATE)) == 0)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in slices(batches):
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = Counter(words_of(text))
                mine = seen.setdefault(one, Counter())
                for w, n in words.items():
                    p = f"{_START}{w.decode(errors='replace')}{_END}"
                    for i in range(len(p) - ORDER + 1):
                        mine[p[i : i + ORDER]] += n
        rows = [(k, g, n) for k, c in seen.items() for g, n in c.items()]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["lang", "gram", "n"])

    counts: dict[str, Counter] = {k: Counter() for k in sizes}
    grams = sample.filter("NOT kept").select("lang", "text").mapInArrow(lambda b: tidy(count(b)), "lang string, gram string, n long")
    for r in grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect():  # as the sample is bounded
        counts[r.lang][r.gram] = r.n
    languages = sorted(k for k, c in counts.items() if c)
    if not languages:
        return None
    models = Models(languages, counts)
    sent = docs.sparkSession.sparkContext.broadcast(models)
    scored = sample.filter("kept").select("lang", "text").mapInArrow(lambda b: _predict(b, sent), f"lang string, {PREDICTED}")
    limits: dict[str, list[float]] = {k: [] for k in languages}
    for r in scored.filter("lang = lang_pred").select("lang_pred", "cross_entropy").collect():
        limits[r.lang_pred].append(r.cross_entropy)
    everything = [x for v in limits.values() for x in v]
    models.limits = {k: float(np.quantile(v or everything, QUANTILE)) * SLACK if everything else math.inf for k, v in limits.items()}
    return models


def _predict(batches: Iterable[pa.RecordBatch], sent, field: int | None = None) -> Iterator[pa.RecordBatch]:
    """First column as it is, then lang_pred, score and cross_entropy of the texts, which are in
    the second column or in a field of the first."""
    models: Models = sent.value
    known: dict[bytes, int] = {}
    n_lang = len(models.languages)
    rows, sizes, filled = np.zeros((_WORDS_KEPT, n_lang), np.float32), np.zeros(_WORDS_KEPT, np.int64), 0
    for batch in slices(batches, 256):
        texts = (batch.column(1) if field is None else field_or_empty(batch.column(0), field)).to_pylist()
        words = [words_of(t) for t in texts]
        missing = list({w for ws in words for w in ws if w not in known})
        if filled + len(missing) > len(rows):
            known.clear()
            filled = 0
            missing = list({w for ws in words for w in ws})
            if len(missing) > len(rows):  # one batch of very long texts
                rows, sizes = np.zeros((len(missing), n_lang), np.float32), np.zeros(len(missing), np.int64)
        step = max(200, 80_000 // n_lang)
        for at in range(0, len(missing), step):
            some = missing[at : at + step]
            rows[filled : filled + len(some)], sizes[filled : filled + len(some)] = models.score(some)
            known.update(zip(some, range(filled, filled + len(some))))
            filled += len(some)
        flat = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64)
        ends = np.cumsum([len(w) for w in words])
        out = []
        for text, ws, end in zip(texts, words, ends):
            if not has_letter(text, ws):
                out.append((UNDETERMINED, 0.0, None, 0))
                continue
            mine = flat[end - len(ws) : end]
            n = int(sizes[mine].sum())
            entropy = -rows[mine].sum(0, dtype=np.float64) / n
            best = int(entropy.argmin())
            sharp = np.exp2(-(entropy - entropy[best]) * min(n, SHARPEST))
            out.append((models.languages[best], float(1 / sharp.sum()), float(entropy[best]), n))
        columns = list(zip(*out)) or [(), (), (), ()]
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            names=[batch.schema.names[0], "lang_pred", "score", "cross_entropy", "letters"],
        )


PREDICTED = "lang_pred string, score double, cross_entropy double, letters long"


def identify(docs: DataFrame, models: Models | None, text: str = "text") -> DataFrame:
    """All columns of docs (in `doc`) with lang_pred, score (0 to 1), cross_entropy (bits a
    character), letters (characters scored) and rejected.

    Texts that are null or have no letter are `und`, score 0, and rejected. Languages that tie
    go by name. Rejected are also texts whose code is SURPLUS bits longer than the limit of
    their language allows. Where nothing could be learned (models is None) every text is `und`,
    score 0, and none is rejected: there is nothing to judge by. Repeated rows are told each;
    an empty table gives no rows; columns named like those added stay inside `doc`.
    """
    given = docs.select(F.struct("*").alias("doc"))
    if models is None:
        return given.select("doc", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(0).cast("long").alias("letters"), F.lit(False).alias("rejected"))
    sent = docs.sparkSession.sparkContext.broadcast(models)
    schema = given.select("doc", *(F.lit(None).cast(k).alias(n) for n, k in (x.split() for x in PREDICTED.split(", ")))).schema
    place = docs.columns.index(text)
    found = given.mapInArrow(lambda b: tidy(_predict(b, sent, place)), schema)
    limit = F.coalesce(*(F.when(F.col("lang_pred") == k, F.lit(v)) for k, v in models.limits.items()))
    return found.withColumn("rejected", F.coalesce((F.col("cross_entropy") - limit) * F.col("letters") > SURPLUS, F.lit(True)))


def held_out(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, 5) == 0


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = fit(docs.select("doc_id", "text", "lang"), ~held_out())
    return identify(docs.select("doc_id", "text"), models).select("doc.doc_id", held_out("doc.doc_id").alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
