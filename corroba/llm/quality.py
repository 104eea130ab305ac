"""Operator 11: quality scores by a convolutional network over bytes, in numpy.

A text is cut into overlapping chunks of bytes that cover all of it. FILTERS learned filters of
WIDTH bytes pass over each chunk. Of each filter the largest response, cut off at zero, is kept in each of
the chunk's WINDOWS windows; the largest and the smallest of these are the chunk's vector, so that
it tells what is there and whether it is everywhere. The largest, the mean and the smallest of a text's
vectors and its length go through a small dense layer to one probability. A filter is a table of a
number for each byte at each of its places, so its response is a sum of WIDTH looked-up numbers.

The network is trained in one task on a bounded sample of labelled texts, by gradient descent: only
the place of the largest response of a window passes a gradient on. It is the same network that
scores, but for its filters' numbers, which are rounded to 16 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.llm._common import as_bytes, crc_mod, materialise, slices, small_batches, table, text_or_empty, tidy

WIDTH, FILTERS, HIDDEN = 6, 24, 16
_VECTOR = 2 * FILTERS
#: Places of a chunk, how far apart chunks begin (neighbours share CHUNK - STRIDE places), and windows of a chunk.
CHUNK, STRIDE, WINDOWS = 256, 224, 4
#: Texts of each label that are learned from at most, each whole and as a crop, and chunks of each, evenly spread over it.
TRAIN_TEXTS, TRAIN_CHUNKS = 1000, 16
EPOCHS, BATCH, RATE = 12, 32, 0.01
#: Steps at least, however few texts there are.
STEPS = 800
#: From this score on a text is predicted to have label 1.
THRESHOLD = 0.3
#: Chunks that are scored at once.
PORTION = 1024
_PAD, _SPAN = 256, CHUNK + WIDTH - 1


def starts_of(size: int) -> np.ndarray:
    """Where the chunks of a text of so many bytes begin; the last one ends with the text."""
    if size <= _SPAN:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, size - _SPAN, STRIDE), size - _SPAN)


def chunks_of(text: bytes, starts: np.ndarray) -> np.ndarray:
    """A row of byte codes a chunk; a shorter text is padded."""
    raw = np.full(max(len(text), _SPAN), _PAD, np.int16)
    raw[: len(text)] = np.frombuffer(text, np.uint8)
    return raw[starts[:, None] + np.arange(_SPAN)]


def size_feature(size: int) -> float:
    return float(np.log1p(size)) / 10


class Network:
    """filters: (WIDTH, 257, FILTERS); bias; dense layer (3 * _VECTOR + 1, HIDDEN), and the output's."""

    def __init__(self, weights: list[np.ndarray], offset: float = 0.0):
        self.weights, self.offset = weights, offset
        filters, bias = weights[:2]
        top = np.abs(filters).max(axis=1).sum(axis=0).max() + np.abs(bias).max()
        self.scale = 32000.0 / max(float(top), 1e-9)
        self.tables = np.rint(filters * self.scale).astype(np.int16)
        self.tables[0] += np.rint(bias * self.scale).astype(np.int16)

    def vectors(self, chunks: np.ndarray) -> np.ndarray:
        """Each chunk's vector: the largest and the smallest of its windows' peaks."""
        out = np.take(self.tables[0], chunks[:, :CHUNK], axis=0)
        for w in range(1, WIDTH):
            out += np.take(self.tables[w], chunks[:, w : w + CHUNK], axis=0)
        out = out.reshape(len(out), WINDOWS, -1, FILTERS)
        while out.shape[2] > 1:  # halves against each other: long runs of memory
            half = out.shape[2] // 2
            out = np.maximum(out[:, :, :half], out[:, :, half:])
        peaks = np.maximum(out[:, :, 0], 0)
        return np.concatenate([peaks.max(1), peaks.min(1)], 1).astype(np.float32) / np.float32(self.scale)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """A probability a text; chunks of many texts are worked on together, those of a long one in portions."""
        pooled = np.zeros((len(texts), 3 * _VECTOR + 1), np.float32)
        waiting: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []

        def work() -> None:
            found, at = self.vectors(np.concatenate(waiting)), 0
            for i, n in owners:
                own = found[at : at + n]
                add_to(pooled[i], own)
                at += n
            waiting.clear()
            owners.clear()

        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            starts = starts_of(len(text))
            sizes[i] = len(starts)
            pooled[i, 2 * _VECTOR : -1] = np.inf
            pooled[i, -1] = size_feature(len(text))
            for at in range(0, len(starts), PORTION):
                some = starts[at : at + PORTION]
                waiting.append(chunks_of(text[some[0] : some[-1] + _SPAN], some - some[0]))
                owners.append((i, len(some)))
                if sum(n for _, n in owners) >= PORTION:
                    work()
        if owners:
            work()
        pooled[:, _VECTOR : 2 * _VECTOR] /= sizes[:, None]
        _, _, dense, dense_bias, last, last_bias = self.weights
        z = np.tanh(pooled @ dense + dense_bias) @ last + last_bias[0] + self.offset
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def add_to(pooled: np.ndarray, vectors: np.ndarray) -> None:
    """Further chunk vectors of a text: largest, sum and smallest."""
    np.maximum(pooled[:_VECTOR], vectors.max(0), out=pooled[:_VECTOR])
    pooled[_VECTOR : 2 * _VECTOR] += vectors.sum(0)
    np.minimum(pooled[2 * _VECTOR : -1], vectors.min(0), out=pooled[2 * _VECTOR : -1])


def _first_weights(rng: np.random.Generator) -> list[np.ndarray]:
    filters = rng.normal(0, 0.35, (WIDTH, 257, FILTERS))
    filters[:, _PAD] = 0
    return [x.astype(np.float32) for x in (filters, np.zeros(FILTERS), rng.normal(0, 0.1, (3 * _VECTOR + 1, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1))]


def train(examples: list[tuple[np.ndarray, int, int]], seed: int = 11, epochs: int = EPOCHS) -> list[np.ndarray]:
    """Weights learned from (chunks, bytes of the text, label)."""
    rng = np.random.default_rng(seed)
    weights = _first_weights(rng)
    moment, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    epochs = max(epochs, STEPS * BATCH // len(examples))
    step, batches = 0, epochs * (-(-len(examples) // BATCH))
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), BATCH):
            step += 1
            rate = RATE * (1 - step / (batches + 1))
            for k, g in enumerate(_gradients(weights, [examples[i] for i in order[at : at + BATCH]])):
                moment[k] += 0.1 * (g - moment[k])
                square[k] += 0.01 * (g * g - square[k])
                weights[k] -= rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)
    return weights


def _gradients(weights: list[np.ndarray], batch: list[tuple[np.ndarray, int, int]]) -> list[np.ndarray]:
    filters, bias, dense, dense_bias, last, last_bias = weights
    chunks = np.concatenate([c for c, _, _ in batch])
    sizes = np.array([len(c) for c, _, _ in batch])
    first = np.cumsum(sizes) - sizes
    response = filters[0][chunks[:, :CHUNK]]
    for w in range(1, WIDTH):
        response += filters[w][chunks[:, w : w + CHUNK]]
    response = response.reshape(len(chunks), WINDOWS, -1, FILTERS)
    place = response.argmax(2)
    peak = np.take_along_axis(response, place[:, :, None], 2)[:, :, 0] + bias  # (chunks, WINDOWS, FILTERS)
    place += np.arange(WINDOWS)[:, None] * (CHUNK // WINDOWS)
    chosen = peak.argmax(1), peak.argmin(1)
    vector = np.maximum(np.concatenate([peak.max(1), peak.min(1)], 1), 0)
    high, mean, low = np.maximum.reduceat(vector, first), np.add.reduceat(vector, first) / sizes[:, None], np.minimum.reduceat(vector, first)
    length = np.array([[size_feature(n)] for _, n, _ in batch], np.float32)
    pooled = np.concatenate([high, mean, low, length], 1)
    hidden = np.tanh(pooled @ dense + dense_bias)
    label = np.array([y for _, _, y in batch], np.float32)
    off = (1 / (1 + np.exp(-(hidden @ last + last_bias[0]))) - label) / len(batch)
    back = (off[:, None] * last) * (1 - hidden**2)
    to_pooled = back @ dense.T
    own = np.repeat(np.arange(len(batch)), sizes)
    to_high, to_mean, to_low = (to_pooled[own, k * _VECTOR : (k + 1) * _VECTOR] for k in range(3))
    to_vector = to_mean / sizes[own][:, None]
    for to, pool in ((to_high, high), (to_low, low)):  # chunks that tie share the gradient
        at = vector == pool[own]
        to_vector += np.where(at, to / np.add.reduceat(at.astype(np.float32), first)[own], 0)
    to_peak = np.zeros_like(peak)
    for k, at in enumerate(chosen):
        np.put_along_axis(to_peak, at[:, None], np.take_along_axis(to_peak, at[:, None], 1) + to_vector[:, None, k * FILTERS : (k + 1) * FILTERS], 1)
    to_peak[peak <= 0] = 0
    to_filters = np.zeros_like(filters)
    rows, window, which = np.nonzero(to_peak)
    value, where = to_peak[rows, window, which], place[rows, window, which]
    for w in range(WIDTH):
        np.add.at(to_filters[w], (chunks[rows, where + w], which), value)
    to_filters[:, _PAD] = 0
    return [to_filters, to_peak.sum((0, 1)), pooled.T @ back, back.sum(0), hidden.T @ off, np.array([off.sum()], np.float32)]


def crop(text: bytes) -> bytes:
    """A short run of the text's words, of a length by its digest: short texts are learned from, too."""
    rng = np.random.default_rng(zlib.crc32(text))
    size = int(np.exp(rng.uniform(np.log(4), np.log(400))))
    at = int(rng.integers(0, max(1, len(text) - size)))
    some = text[at : at + size]
    return some[some.find(b" ") + 1 :] if at and 0 <= some.find(b" ") < len(some) - 1 else some


def _examples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text (the last column) and of a crop of it the length and at most TRAIN_CHUNKS chunks,
    as bytes, beside the other columns."""
    for batch in slices(batches):
        sizes, chunks = [], []
        for whole in as_bytes(batch.column(3)):
            for text in (whole, crop(whole)):
                starts = starts_of(len(text))
                if len(starts) > TRAIN_CHUNKS:
                    starts = starts[np.linspace(0, len(starts) - 1, TRAIN_CHUNKS).astype(np.int64)]
                sizes.append(len(text))
                chunks.append(chunks_of(text, starts).tobytes())
        each = pa.array(np.repeat(np.arange(batch.num_rows), 2))
        yield pa.RecordBatch.from_arrays([*(c.take(each) for c in batch.columns[:3]), pa.array(sizes, pa.int64()), pa.array(chunks, pa.binary())], names=["id", "label", "h", "size", "chunks"])


def _trained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    examples = []
    for batch in batches:
        for raw, size, label in zip(*(c.to_pylist() for c in batch.columns)):
            examples.append((np.frombuffer(raw, np.int16).reshape(-1, _SPAN), size, label))
    examples.sort(key=lambda x: (x[0].tobytes(), x[1:]))  # whatever order they came in
    flat = np.concatenate([w.ravel() for w in train(examples)])
    yield pa.RecordBatch.from_arrays([pa.array([flat.astype(np.float32).tobytes()])], names=["weights"])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text: str = "text", label: str = "quality", train_texts: int = TRAIN_TEXTS) -> Network | float:
    """A network learned from usable documents with a label of 0 or 1: at most about train_texts of each, by
    a hash of the id. Where documents of only one label are there, that label's share (1.0 or
    0.0), and without any 0.5: then nothing can be told apart.

    An id that is labelled more than once has its highest label; null ids and labels, and labels
    beside 0 and 1, teach nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    told = labels.filter(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))
    told = told.filter(usable).withColumn("h", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)))
    sizes = {r.label: r.n for r in told.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return float(next(iter(sizes), 0.5))
    # half as many again, as not every labelled id need have a text
    share = F.when(F.col("label") == 1, min(1.0, 1.5 * train_texts / sizes[1])).otherwise(min(1.0, 1.5 * train_texts / sizes[0]))
    chosen = told.filter(F.col("h") < share * (1 << 30))
    known = docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("text")).join(F.broadcast(chosen), "id").select("id", "label", "h", "text")
    kind = docs.schema[id_col].dataType.simpleString()
    known = materialise(known.mapInArrow(lambda b: tidy(_examples(b)), f"id {kind}, label int, h long, size long, chunks binary"), "examples")
    some = [known.filter(F.col("label") == k).orderBy("h", "id", "chunks").limit(2 * train_texts) for k in (0, 1)]
    used = [x.count() for x in some]
    if not all(used):
        return float(used[1] > 0) if any(used) else 0.5
    found = some[0].union(some[1]).select("chunks", "size", "label").coalesce(1).mapInArrow(lambda b: tidy(_trained(b)), "weights binary").first()
    # labels are learned from in other shares than they have
    return Network(_shaped(found.weights), float(np.log(sizes[1] / sizes[0]) - np.log(used[1] / used[0])))


def _shaped(raw: bytes) -> list[np.ndarray]:
    flat, at, weights = np.frombuffer(raw, np.float32), 0, []
    for like in _first_weights(np.random.default_rng(0)):
        weights.append(flat[at : at + like.size].reshape(like.shape).copy())
        at += like.size
    return weights


def score(docs: DataFrame, network: Network | float, threshold: float = THRESHOLD, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1, higher: label 1 likelier) and predicted (1 from the threshold on).

    Null texts count as empty; an empty text is one chunk of padding and has a score like any
    other. Long texts are read whole, in portions. Repeated rows are scored each and alike;
    other columns are ignored, whatever their names; an empty table gives no rows.
    """
    given = docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("text"))
    if isinstance(network, float):
        out = given.select("id", F.lit(network).alias("score"))
    else:
        sent = docs.sparkSession.sparkContext.broadcast(network)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(as_bytes(batch.column(1))))], names=["id", "score"])

        out = given.mapInArrow(lambda b: tidy(run(b)), f"id {docs.schema[id_col].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, 5) == 0


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = fit(docs, table(spark, sf_dir, "labels"), ~held_out("id"))
    return score(docs, network).select("doc_id", held_out().alias("held_out"), "score", "predicted")
