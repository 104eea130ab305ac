"""Operator 4: language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions, and every decision (node of the byte's tree) has a
context tree over the DEPTH bytes before. At each context the Krichevsky-Trofimov estimate is
weighted against the product of the deeper contexts, so all depths mix by how well they coded
the training texts. The tree has every context that the training texts have: it grows with
them, and no context is left out. A context that they don't have ends one level higher.

A gram is a context and the byte after it, in one number: the byte just before comes first,
so sorted grams have the contexts of each depth side by side. The steps, all distributed:

1. Texts are dealt to blocks; a block's distinct grams are sorted and counted, and go as
   compressed arrays to slots, by a hash of their TOP nearest bytes.
2. A slot adds up the counts of all blocks. All contexts below TOP bytes lie in it whole, so it
   computes their weights, and for each gram and decision the mixture of the depths from TOP on.
3. What the contexts of TOP bytes are worth is summed for the shorter ones, of which there are
   256**(TOP-1) at most; their weights are broadcast.
4. Each block gets the log-probabilities of its own grams back and adds them up by document.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.llm._common import as_bytes, crc_mod, materialise, slices, table, text_or_empty, tidy

#: Bytes of a context; of the contexts from TOP bytes on each slot has all that share TOP bytes.
DEPTH, TOP = 6, 3
#: Bytes of text of a block, of the text behind a slot, and of the texts that a task reads at a time.
BLOCK_BYTES, SLOT_BYTES, PORTION = 32 << 20, 2 << 20, 4 << 20
#: Most frequent tokens whose counts are broadcast; the others are joined.
FREQUENT = 50_000
#: Longer tokens are known by a digest.
TOKEN_BYTES = 64
#: Log-odds are kept in this part of a unit; UNSEEN stands where no context of TOP bytes is known.
ODDS, UNSEEN = 1000.0, -32768
_LN2 = math.log(2)
_ALL = 8 * (DEPTH + 1)
_CODEC = pa.Codec("zstd", compression_level=1)
_SMALL = 1 << 16
_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_SMALL - 1) + 0.5))])
_WHOLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1.0, _SMALL)))])


def _log_product(n: np.ndarray, known: np.ndarray, first: float) -> np.ndarray:
    """ln of first * (first + 1) * ... of n factors; by Stirling's series beyond the table."""
    out = known[np.minimum(n, _SMALL - 1)]
    big = np.flatnonzero(n >= _SMALL)
    if len(big):
        x = n[big] + first
        out[big] = (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) - math.lgamma(first)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_product(zeros, _HALF, 0.5) + _log_product(ones, _HALF, 0.5) - _log_product(zeros + ones, _WHOLE, 1.0)


def press(x: np.ndarray) -> bytes:
    """The numbers' bytes, place by place, compressed: high bytes of sorted numbers are alike."""
    return _CODEC.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T), asbytes=True)


def expand(raw: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(_CODEC.decompress(raw, n * size, asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def grams_of(texts: list[bytes]) -> np.ndarray:
    """The gram at each byte of the texts; line feeds stand before a text."""
    pad = b"\n" * DEPTH
    raw = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8)
    if len(raw) <= DEPTH:
        return np.zeros(0, np.uint64)
    grams = np.zeros(len(raw) - DEPTH, np.uint64)
    for back in range(1, DEPTH + 1):
        grams |= raw[DEPTH - back : len(raw) - back]
        grams <<= np.uint64(8)
    grams |= raw[DEPTH:]
    own = np.ones(len(grams) + DEPTH, bool)
    starts = np.cumsum([0, *(len(t) + DEPTH for t in texts[:-1])])
    for k in range(DEPTH):
        own[starts + k] = False
    return grams[own[DEPTH:]]


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order, and how often each occurs."""
    grams = np.sort(grams)
    first = _first(grams)
    return grams[first], np.diff(np.append(first, len(grams)))


def _first(x: np.ndarray) -> np.ndarray:
    """Where another number begins in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(grams)
    grams, n = grams[order], n[order]
    first = _first(grams)
    return grams[first], np.add.reduceat(n, first) if len(first) else n


class Subtrees:
    """The context trees of grams that share their TOP nearest bytes or more.

    grams: sorted, distinct; n: how often the training texts have each, 0 for those that are
    only asked for. odds: for each decision and gram, the log-odds of a one by the depths from
    TOP on; top: what the trees give the contexts of TOP - 1 bytes.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        keys, count, at = grams, n, np.arange(len(grams))
        one_by = np.zeros((8, len(grams)))
        below: list[tuple] = []
        self.top: list[tuple[np.ndarray, ...]] = []
        for depth in range(DEPTH, TOP - 1, -1):
            level = []
            for k in range(8):
                prefix = keys >> np.uint64(8 - k)  # the context and the decisions before
                first = _first(prefix)
                group = np.zeros(len(keys), np.int64)
                group[first[1:]] = 1
                own = np.cumsum(group)[at]
                prefix = prefix[first]
                total = np.add.reduceat(count, first)
                ones = np.add.reduceat(np.where(keys >> np.uint64(7 - k) & np.uint64(1) == 1, count, 0), first)
                weight = log_kt(total - ones, ones)
                estimate = ((ones + 0.5) / (total + 1.0))[own]
                if depth == DEPTH:
                    one_by[k] = estimate
                else:
                    deep_prefix, deep_weight, deep_seen = below[k]
                    parent = deep_prefix >> np.uint64(8 + k) << np.uint64(k) | deep_prefix & np.uint64((1 << k) - 1)
                    deeper = np.bincount(np.searchsorted(prefix, parent), deep_weight, len(prefix))
                    stops = weight - _LN2
                    weight = np.logaddexp(stops, deeper - _LN2)
                    share = np.exp(stops - weight)[own]
                    one_by[k] = np.where(deep_seen, share * estimate + (1 - share) * one_by[k], estimate)
                level.append((prefix, weight, (total > 0)[own]))
                if depth == TOP:
                    self.top.append((prefix, weight, total - ones, ones, k))
            below = level
            if depth > TOP:
                keys, inverse = np.unique(keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255), return_inverse=True)
                count = np.bincount(inverse, count, len(keys)).astype(np.int64)
                at = inverse[at]
        odds = np.log(one_by) - np.log1p(-one_by)
        seen = np.stack([x[2] for x in below])
        self.odds = np.where(seen, np.clip(np.rint(odds * ODDS), -32767, 32767), UNSEEN).astype(np.int16)

    def upward(self) -> tuple[np.ndarray, ...]:
        """By context of TOP - 1 bytes and node: the sum of the weights, of zeros and of ones."""
        parts = []
        for prefix, weight, zeros, ones, k in self.top:
            key = prefix >> np.uint64(8 + k) << np.uint64(8) | np.uint64(1 << k) | prefix & np.uint64((1 << k) - 1)
            parts.append((key, weight, zeros, ones))
        key, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return key.astype(np.int64), *(np.bincount(inverse, np.concatenate([p[i] for p in parts]), len(key)) for i in (1, 2, 3))


class Top:
    """The depths below TOP mixed: with p the mixture of the deeper ones, a one's probability at
    a context of TOP - 1 bytes and node is given + left * p, or `alone` where no deeper is known."""

    def __init__(self, key: np.ndarray, weight: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        order = np.argsort(key)
        key, deeper, zeros, ones = key[order], weight[order], zeros[order].astype(np.int64), ones[order].astype(np.int64)
        self.key = key
        levels = []
        at = np.arange(len(key))  # of each key at its level
        for depth in range(TOP - 1, -1, -1):
            stops = log_kt(zeros, ones) - _LN2
            weight = np.logaddexp(stops, deeper - _LN2)
            levels.append((np.exp(stops - weight)[at], ((ones + 0.5) / (zeros + ones + 1.0))[at], (zeros + ones > 0)[at]))
            if depth:
                short, inverse = np.unique(key >> 16 << 8 | key & 255, return_inverse=True)
                deeper, zeros, ones = (np.bincount(inverse, x, len(short)) for x in (weight, zeros, ones))
                zeros, ones = zeros.astype(np.int64), ones.astype(np.int64)
                key, at = short, inverse[at]
        self.given, self.left = np.zeros(len(self.key)), np.ones(len(self.key))
        self.alone = np.full(len(self.key), 0.5)
        for share, estimate, seen in reversed(levels):  # from the root on
            self.alone = np.where(seen, self.given + self.left * estimate, self.alone)
            self.given = self.given + np.where(seen, self.left * share * estimate, 0)
            self.left = np.where(seen, self.left * (1 - share), self.left)

    def log10(self, grams: np.ndarray, odds: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams))
        context = (grams >> np.uint64(_ALL - 8 * (TOP - 1)) << np.uint64(8)).astype(np.int64)
        byte = (grams & np.uint64(255)).astype(np.int64)
        for k in range(8):
            at = np.searchsorted(self.key, context | 1 << k | byte >> (8 - k))
            given, left, alone = self.given[at], self.left[at], self.alone[at]
            p = 1 / (1 + np.exp(odds[k] / -ODDS))
            one = np.where(odds[k] == UNSEEN, alone, given + left * p)
            zero = np.where(odds[k] == UNSEEN, 1 - alone, np.maximum(0, 1 - given - left) + left * (1 - p))
            out += np.log10(np.where(byte >> (7 - k) & 1 == 1, one, zero))
        return out


class Table:
    """Log-probabilities by gram: sorted by a hash, with an index of its first bits."""

    _MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, grams: np.ndarray, logs: np.ndarray):
        self.shift = np.uint64(64 - max(1, int(len(grams)).bit_length()))
        hashes = grams * self._MIX  # odd, so no two grams share a hash
        order = np.argsort(hashes)
        self.hashes, self.logs = hashes[order], logs[order]
        slots = np.arange((1 << (64 - int(self.shift))), dtype=np.uint64) << self.shift
        self.first = np.searchsorted(self.hashes, slots).astype(np.int32)

    def find(self, grams: np.ndarray) -> np.ndarray:
        hashes = grams * self._MIX
        at = self.first[(hashes >> self.shift).astype(np.int64)]
        rest = np.flatnonzero(self.hashes.take(at, mode="clip") != hashes)
        while len(rest):
            at[rest] += 1
            if at[rest].max() >= len(self.hashes):
                raise ValueError("a text that its block did not have when grams were counted: the input changes from read to read")
            rest = rest[self.hashes[at[rest]] != hashes[rest]]
        return self.logs[at]


def token_key(token: bytes) -> bytes:
    """Short tokens as they are; a space, which no token holds, and a digest of longer ones."""
    return token if len(token) <= TOKEN_BYTES else b" " + hashlib.blake2b(token, digest_size=16).digest()


def _tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts of a task, given out whenever there are many distinct ones."""
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(map(token_key, seen), pa.binary()), pa.array(seen.values(), pa.int64())], names=["token", "c"])

    for batch in slices(batches):
        for text in as_bytes(batch.column(0)):
            seen.update(text.lower().split())
        if len(seen) > 300_000:
            yield out()
            seen = Counter()
    yield out()


def _gather(batches: Iterable[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """slot, block, n, grams, counts: the distinct grams of the one block that a task has."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    texts: dict[bool, list[bytes]] = {True: [], False: []}
    waiting, block = 0, None

    def take() -> None:
        for training, some in texts.items():
            if any(some):
                grams, n = counted(grams_of(some))
                parts.append((grams, n if training else np.zeros(len(n), np.int64)))
            some.clear()
        if len(parts) > 2 and sum(len(p[0]) for p in parts[1:]) > len(parts[0][0]):
            parts[:] = [merged(parts)]

    for batch in slices(batches):
        for one, training, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
            block = one
            texts[training].append(text)
            waiting += len(text)
            if waiting >= PORTION:
                take()
                waiting = 0
    take()
    if not parts:
        return
    grams, n = merged(parts)
    slot = ((grams >> np.uint64(_ALL - 8 * TOP)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & (slots - 1)
    order = np.argsort(slot, kind="stable")
    grams, n, slot = grams[order], n[order], slot[order]
    first = _first(slot)
    rows = []
    for a, b in zip(first, [*first[1:], len(slot)]):
        rows.append({"slot": int(slot[a]), "block": block, "n": int(b - a), "grams": press(grams[a:b]), "counts": press(n[a:b].astype(np.uint32 if n[a:b].max() < 1 << 32 else np.int64)), "wide": bool(n[a:b].max() >= 1 << 32)})
        if len(rows) == 64:
            yield pa.RecordBatch.from_pylist(rows, schema=_GATHERED)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, schema=_GATHERED)


_GATHERED = pa.schema([("slot", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary()), ("wide", pa.bool_())])
GATHERED = "slot int, block int, n int, grams binary, counts binary, wide boolean"
_TREES = pa.schema(
    [
        ("n", pa.int32()), ("grams", pa.binary()), ("odds", pa.binary()), ("blocks", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("places", pa.list_(pa.binary())),
        ("keys", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64())), ("zeros", pa.list_(pa.float64())), ("ones", pa.list_(pa.float64())),
    ]
)
TREES = "n int, grams binary, odds binary, blocks array<int>, sizes array<int>, places array<binary>, keys array<long>, weights array<double>, zeros array<double>, ones array<double>"


def _grow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each slot; its rows come one after another."""

    def grown(rows: list[tuple]) -> pa.RecordBatch:
        parts = [(expand(grams, n, "<u8"), expand(counts, n, "<i8" if wide else "<u4").astype(np.int64)) for _, _, n, grams, counts, wide in rows]
        grams, n = merged(parts)
        trees = Subtrees(grams, n)
        places = [np.searchsorted(grams, p[0]) for p in parts]
        row = [len(grams), press(grams), press(np.ascontiguousarray(trees.odds.T).view("<u8").ravel()) if len(grams) else b"", [r[1] for r in rows], [r[2] for r in rows]]
        row += [[press(np.diff(x, prepend=0).astype("<u4")) for x in places], *(x.tolist() for x in trees.upward())]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _TREES)], schema=_TREES)

    held: list[tuple] = []
    for batch in slices(batches, 64):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                yield grown(held)
                held = []
            held.append(row)
    if held:
        yield grown(held)


def _tell(batches: Iterable[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """block, n, grams, logs: for each slot and block the log-probabilities of its grams."""
    for batch in slices(batches, 1):
        for n, raw, odds, blocks, sizes, places in zip(*(c.to_pylist() for c in batch.columns)):
            grams = expand(raw, n, "<u8")
            logs = sent.value.log10(grams, expand(odds, 2 * n, "<u8").view("<i2").reshape(n, 8).T).astype("<f4")
            rows = []
            for block, size, place in zip(blocks, sizes, places):
                at = np.cumsum(expand(place, size, "<u4").astype(np.int64))
                rows.append((block, size, press(grams[at]), press(logs[at])))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "n", "grams", "logs"])


def fit(texts: DataFrame, blocks: int, slots: int) -> DataFrame:
    """texts: block, training, text. A row for each slot with its grams, their log-odds and
    who asks for them; as a written table."""
    parts = min(slots, max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), slots // 32))
    gathered = texts.select("block", "training", "text").repartitionById(blocks, "block").mapInArrow(lambda b: tidy(_gather(b, slots)), GATHERED)
    grown = gathered.repartitionById(parts, F.pmod("slot", F.lit(parts))).sortWithinPartitions("slot").mapInArrow(lambda b: tidy(_grow(b)), TREES)
    return materialise(grown, "trees")


def top_of(trees: DataFrame) -> Top:
    """Sums over slots: a row for each context of TOP - 1 bytes and node, 255 * 256**2 at most."""
    rows = trees.select(F.explode(F.arrays_zip("keys", "weights", "zeros", "ones")).alias("r")).groupBy(F.col("r.keys").alias("key"))
    found = rows.agg(*(F.sum(f"r.{c}").alias(c) for c in ("weights", "zeros", "ones"))).toArrow()
    return Top(*(found[c].to_numpy() for c in ("key", "weights", "zeros", "ones")))


SCORED = "row long, doc_id long, training boolean, n_tokens long, n_known long, base double, score double, code_length double, rest map<binary,long>"


def score(docs: DataFrame, training: F.Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs, with the model of the rows where `training` holds: doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score (log10) and code_length (bits a byte;
    null for empty texts).

    Null texts are empty: one token, the end. Every row is scored by itself, repeated or not,
    also rows without an id and rows of one id with different texts. Rows of equal text have equal scores but
    for rounding. An empty table gives no rows; without training rows every token is unknown
    and every decision has probability one half. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    size = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"), F.count_if("training").alias("train")).first()
    blocks = max(1, math.ceil(size.n / BLOCK_BYTES), min(spark.sparkContext.defaultParallelism, size.n // (8 << 20)))
    slots = 1 << max(0, math.ceil(size.n / SLOT_BYTES) - 1).bit_length()
    placed = given.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    trees = fit(placed, blocks, slots)
    top = spark.sparkContext.broadcast(top_of(trees))

    tokens = given.filter("training").select("text").mapInArrow(lambda b: tidy(_tally(b)), "token binary, c long")
    counts = materialise(tokens.groupBy("token").agg(F.sum("c").alias("c")), "tokens")
    known = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n_train = size.train
    total, distinct = known.n + n_train, known.v + (n_train > 0)  # with the end token
    frequent = counts.orderBy(F.desc("c"), "token").limit(FREQUENT).toArrow()  # of TOKEN_BYTES at most
    sent = spark.sparkContext.broadcast(dict(zip(frequent["token"].to_pylist(), np.log10(frequent["c"].to_numpy() + 1.0).tolist())))
    whole = float(np.log10(float(total + distinct + 1)))
    end = float(np.log10(n_train + 1.0))

    def scored(texts: list[bytes], model: Table | None) -> Iterator[tuple]:
        logs, get = sent.value, sent.value.get
        grams = grams_of(texts)
        ends = np.cumsum([len(t) for t in texts])
        sums = np.concatenate([[0.0], np.cumsum(model.find(grams), dtype=np.float64)]) if len(grams) else np.zeros(1)
        for text, stop in zip(texts, ends):
            words = text.lower().split()
            found = list(map(get, words))
            rest: dict[bytes, int] = {}
            if None in found:
                for w in [w for w, x in zip(words, found) if x is None]:
                    w = token_key(w)
                    rest[w] = rest.get(w, 0) + 1
                found = [x for x in found if x is not None]
                for w in [w for w in rest if len(w) == 17 and w in logs]:  # long and frequent
                    found += [logs[w]] * rest.pop(w)
            p = float(sums[stop] - sums[stop - len(text)])
            base = math.fsum(found) + end - (len(words) + 1) * whole
            yield len(words) + 1, len(found) + (n_train > 0), base, p, -p / math.log10(2) / len(text) if text else None, list(rest.items())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, model, n = [], None, 0
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.map_(pa.binary(), pa.int64()))
        names = ["row", "doc_id", "training", "n_tokens", "n_known", "base", "score", "code_length", "rest"]
        for batch in slices(batches, 256):
            texts, known = batch.column("text"), batch.column("n").to_pylist()
            split = sum(x is not None for x in known)  # the log-probabilities come first
            for x, grams, logs in zip(known[:split], batch.column("grams")[:split].to_pylist(), batch.column("logs")[:split].to_pylist()):
                parts.append((expand(grams, x, "<u8"), expand(logs, x, "<f4")))
            if split == batch.num_rows:
                continue
            if parts:
                model, parts = Table(*(np.concatenate([p[k] for p in parts]) for k in (0, 1))), []
            texts, held = as_bytes(texts[split:]), []
            at = split
            for i, text in enumerate(texts):
                held.append(text)
                if i + 1 == len(texts) or sum(map(len, held)) + len(texts[i + 1]) > PORTION:
                    columns = [pa.array(list(c), k) for c, k in zip(zip(*scored(held, model)), kinds)]
                    block = batch.column("block")[at].as_py()
                    ids = pa.array([block << 40 | n + j for j in range(len(held))], pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, batch.column("doc_id").slice(at, len(held)), batch.column("training").slice(at, len(held)), *columns], names=names)
                    at, n, held = at + len(held), n + len(held), []

    told = trees.select("n", "grams", "odds", "blocks", "sizes", "places").mapInArrow(lambda b: tidy(_tell(b, top)), "block int, n int, grams binary, logs binary")
    both = placed.select("block", F.lit(None).cast("int").alias("n"), F.lit(None).cast("binary").alias("grams"), F.lit(None).cast("binary").alias("logs"), "doc_id", "training", "text")
    both = told.select("block", "n", "grams", "logs", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("training"), F.lit(None).cast("string").alias("text")).union(both)
    both = both.repartitionById(blocks, "block").sortWithinPartitions(F.col("n").isNull())
    rows = materialise(both.mapInArrow(lambda b: tidy(run(b)), SCORED), "scored")
    # rarer tokens: a row for each token and text that has it, joined with the counts and summed back
    rest = rows.select("row", F.explode("rest").alias("token", "k"))
    found = rest.join(counts, "token").groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("gain"))
    return rows.drop("rest").join(found, "row", "left").select(
        "doc_id",
        (~F.col("training")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
        "score",
        "code_length",
    )


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
