"""Operator 8: token-ID files, coded by a static range asymmetric numeral system.

One frequency table of the whole corpus is shared by all blocks. A block holds up to
BLOCK ids, dealt to LANES interleaved coder states; it decodes alone. Rows of the file
(groups of whole documents) carry the documents' ids and lengths as checkpoints and a
checksum of each block, so tasks decode groups in parallel and find damage.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroba.llm._common import crc32_of_ids, materialise, scratch_path, slices, table, text_or_empty
from corroba.llm.tokens import part_cache, tokenizer_path

#: Frequencies add up to 2**SCALE; coder states stay in [2**31, 2**63).
SCALE, LOW = 20, 31
BLOCK, LANES = 32_768, 128
#: Ids of a group, but for a longer single document; a worker holds one group.
GROUP = 1 << 19
END_ID = 1


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts scaled to the sum 2**scale; each id that occurs keeps at least 1."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.int64)
    present = counts > 0
    if int(present.sum()) > 1 << scale:
        raise ValueError("more ids than the scale holds")
    freq = np.where(present, np.maximum(1, counts.astype(np.float64) * (1 << scale) // total), 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    over = int(freq.sum()) - (1 << scale)
    if over < 0:
        freq[order[0]] -= over
    while over > 0:
        for i in order:
            cut = min(over, int(freq[i]) - 1, max(1, int(freq[i]) // 8))
            freq[i] -= cut
            over -= cut
            if not over:
                break
    return freq


def encode_blocks(ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> list[bytes]:
    """Payloads of the blocks of ids: LANES states, LANES word counts, then each lane's words."""
    blocks = max(1, -(-len(ids) // BLOCK))
    steps = -(-min(len(ids), BLOCK) // LANES)
    pad = np.full(blocks * BLOCK, -1, np.int32)
    pad[: len(ids)] = ids
    symbols = pad.reshape(blocks, BLOCK)[:, : steps * LANES].reshape(blocks, steps, LANES).transpose(1, 0, 2).reshape(steps, blocks * LANES)
    state = np.full(blocks * LANES, 1 << LOW, np.uint64)
    words = np.zeros((steps, blocks * LANES), np.uint32)
    sent = np.zeros((steps, blocks * LANES), bool)
    limit_shift, scale, low32, shift32 = np.uint64(LOW - SCALE + 32), np.uint64(SCALE), np.uint64(0xFFFFFFFF), np.uint64(32)
    for t in range(steps - 1, -1, -1):
        s = symbols[t]
        live = s >= 0
        at = np.where(live, s, 0)
        f = np.where(live, freq[at], 1).astype(np.uint64)
        full = live & (state >= (f << limit_shift))
        words[t], sent[t] = (state & low32).astype(np.uint32), full
        x = np.where(full, state >> shift32, state)
        q = x // f
        state = np.where(live, (q << scale) + (x - q * f) + start[at].astype(np.uint64), x)
    out = []
    n_words = sent.sum(0).astype("<u2")
    for b in range(blocks):
        lanes = slice(b * LANES, (b + 1) * LANES)
        body = words[:, lanes].T[sent[:, lanes].T]  # lane by lane, in the order of decoding
        out.append(state[lanes].astype("<u8").tobytes() + n_words[lanes].tobytes() + body.astype("<u4").tobytes())
    return out


def decode_blocks(payloads: list[bytes], sizes: list[int], freq: np.ndarray, start: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The ids of blocks, all lanes of all blocks at once. symbol: the id of each slot."""
    state, first, words, at = [], [], [], 0
    for p in payloads:
        n = np.frombuffer(p, "<u2", LANES, LANES * 8).astype(np.int64)
        state.append(np.frombuffer(p, "<u8", LANES))
        first.append(at + np.cumsum(n) - n)
        words.append(np.frombuffer(p, "<u4", -1, LANES * 10))
        at += int(n.sum())
    state, pointer = np.concatenate(state).astype(np.uint64), np.concatenate(first)
    stream = np.concatenate([*words, np.zeros(1, np.uint32)]).astype(np.uint64)
    size = np.repeat(np.array(sizes), LANES)
    lane = np.tile(np.arange(LANES), len(payloads))
    steps = -(-max(sizes, default=0) // LANES)
    out = np.zeros((steps, len(size)), np.int32)
    mask, scale, shift32, low = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32), np.uint64(1 << LOW)
    for t in range(steps):
        live = t * LANES + lane < size
        slot = (state & mask).astype(np.int64)
        s = symbol[slot]
        out[t] = s
        x = freq[s].astype(np.uint64) * (state >> scale) + slot.astype(np.uint64) - start[s].astype(np.uint64)
        need = live & (x < low)
        x = np.where(need, (x << shift32) | stream[np.where(need, pointer, -1)], x)
        pointer = pointer + need
        state = np.where(live, x, state)
    by_block = out.reshape(steps, len(payloads), LANES).transpose(1, 0, 2).reshape(len(payloads), steps * LANES)
    return np.concatenate([by_block[b, :n] for b, n in enumerate(sizes)]) if payloads else np.zeros(0, np.int32)


FILE_SCHEMA = (
    "shard int, group_no int, doc_ids array<long>, doc_lengths array<int>, "
    "block_sizes array<int>, block_crcs array<long>, blocks array<binary>"
)


def tokenise(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian 16-bit, with the end id). Null text is empty: the end id
    alone. Rows are encoded each, repeated or not; other columns are ignored, whatever their
    names; an empty table gives no rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = part_cache(path, "ids"), np.array([END_ID], "<u2").tobytes()
        for batch in slices(batches):
            ids = [x + end for x in cache.ids(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def frequencies(tokens: DataFrame, size: int = 1 << 16) -> np.ndarray:
    """How often each id occurs in the whole corpus; as many numbers as 16-bit ids at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in slices(batches):
            n += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def write_ids(tokens: DataFrame, path: str, counts: np.ndarray) -> None:
    """Write documents in ascending doc_id order: `path`/table holds the frequencies,
    `path`/groups the coded groups. The order of shards, of groups in a shard and of
    documents in a group is that of doc_id; rows without one come first, and rows of one
    doc_id lie by their ids. Of no documents the files are written, too, and read as no rows."""
    spark = tokens.sparkSession
    freq = scaled(counts)
    present = np.flatnonzero(freq)
    spark.createDataFrame([(int(i), int(freq[i])) for i in present], "id int, freq int").coalesce(1).write.parquet(f"{path}/table")
    sent = spark.sparkContext.broadcast(freq)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        freq = sent.value
        start = np.cumsum(freq) - freq
        shard, group_no = TaskContext.get().partitionId(), 0

        def coded(docs: list[int], ids: list[bytes]) -> pa.RecordBatch:
            all_ids = np.frombuffer(b"".join(ids), "<u2").astype(np.int32)
            blocks = encode_blocks(all_ids, freq, start)
            sizes = [min(BLOCK, len(all_ids) - at) for at in range(0, max(1, len(all_ids)), BLOCK)]
            row = {
                "shard": shard, "group_no": group_no, "doc_ids": docs, "doc_lengths": [len(x) // 2 for x in ids],
                "block_sizes": sizes, "block_crcs": [zlib.crc32(b) for b in blocks], "blocks": blocks,
            }
            return pa.RecordBatch.from_pylist([row], schema=ARROW_SCHEMA)

        docs, ids, held = [], [], 0
        for batch in slices(batches):
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if docs and held + len(x) // 2 > GROUP:
                    yield coded(docs, ids)
                    group_no += 1
                    docs, ids, held = [], [], 0
                docs.append(doc)
                ids.append(x)
                held += len(x) // 2
        if docs:
            yield coded(docs, ids)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        tokens.repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "ids")
        .mapInArrow(run, FILE_SCHEMA)
        .write.option("compression", "uncompressed")
        .parquet(f"{path}/groups")
    )


ARROW_SCHEMA = pa.schema(
    [
        ("shard", pa.int32()), ("group_no", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int32())),
        ("block_sizes", pa.list_(pa.int32())), ("block_crcs", pa.list_(pa.int64())), ("blocks", pa.list_(pa.binary())),
    ]
)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode the files: per document doc_id, start, n_tokens, ids_crc32 (and ids, unsigned
    32-bit little-endian). A block whose checksum differs raises an error."""
    freq = np.zeros(1 << 16, np.int64)
    for r in spark.read.parquet(f"{path}/table").collect():  # 16-bit ids: 65,536 rows at most
        freq[r.id] = r.freq
    sent = spark.sparkContext.broadcast(freq)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = sent.value
        start = np.cumsum(freq) - freq
        symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            for b, crc in zip(row["blocks"], row["block_crcs"]):
                if zlib.crc32(b) != crc:
                    raise ValueError(f"damaged block in shard {row['shard']}, group {row['group_no']}")
            ids = decode_blocks(row["blocks"], row["block_sizes"], freq, start, symbol).astype("<u4")
            ends = np.cumsum(row["doc_lengths"])
            cut = [ids[e - n : e] for e, n in zip(ends, row["doc_lengths"])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["shard"]] * len(cut), pa.int32()),
                    pa.array([row["group_no"]] * len(cut), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(ends - row["doc_lengths"], pa.int64()),
                    pa.array(row["doc_lengths"], pa.int64()),
                    pa.array([crc32_of_ids(x) for x in cut], pa.int64()),
                    *([pa.array([x.tobytes() for x in cut], pa.binary())] if with_ids else []),
                ],
                names=["shard", "group_no", "doc_id", "in_group", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])],
            )

    groups = spark.read.parquet(f"{path}/groups")
    lengths = groups.select("shard", "group_no", F.aggregate("doc_lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    in_shard = lengths.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("group_no")) - F.col("n"))
    # one row a shard: as many rows as the write had tasks
    shards = lengths.groupBy("shard").agg(F.sum("n").alias("n")).collect()
    at, offsets = 0, []
    for r in sorted(shards):
        offsets.append((r.shard, at))
        at += r.n
    known = spark.createDataFrame(offsets, "shard int, shard_start long")
    firsts = in_shard.join(known, "shard").select("shard", "group_no", (F.col("shard_start") + F.col("before")).alias("first"))
    columns = "shard int, group_no int, doc_id long, in_group long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return (
        groups.mapInArrow(run, columns)
        .join(firsts, ["shard", "group_no"])
        .select("doc_id", (F.col("first") + F.col("in_group")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
    )


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = materialise(tokenise(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")), "tokens")
    path = scratch_path(spark, "ids")
    write_ids(tokens, path, frequencies(tokens))
    return read_ids(spark, path)
