"""Deterministic chunks: greedy packing of ordered blocks as a fold, with stable ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroba.functions.text import strip

GAP = "\n\n"


@dataclass(frozen=True)
class ChunkSizes:
    """Characters of a chunk; a last chunk of less than `tail` joins the one before."""

    least: int = 800
    target: int = 1000
    most: int = 1200

    @property
    def tail(self) -> int:
        return max(200, self.least // 2)


CHUNK = "struct<text:string,hint:string>"


def pack_blocks(blocks: Column, sizes: ChunkSizes = ChunkSizes()) -> Column:
    """array<struct<text,hint>> of blocks in order -> the same of chunks.

    A block that would lift a chunk of at least `least` over `most` begins a new one; a chunk
    of `target` or more ends; a block's hint stays for its chunk. Blocks are never cut.
    """
    start = F.struct(F.array().cast(f"array<{CHUNK}>").alias("done"), F.lit("").alias("text"), F.lit(None).cast("string").alias("hint"))

    def flushed(done: Column, text: Column, hint: Column) -> Column:
        return F.when(strip(text) != "", F.concat(done, F.array(F.struct(strip(text).alias("text"), hint.alias("hint"))))).otherwise(done)

    def step(state: Column, block: Column) -> Column:
        full = (
            (state.text != "")
            & (F.length(state.text) + len(GAP) + F.length(block["text"]) > sizes.most)
            & (F.length(state.text) >= sizes.least)
        )
        done = F.when(full, flushed(state.done, state.text, state.hint)).otherwise(state.done)
        text = F.when(full | (state.text == ""), block["text"]).otherwise(F.concat(state.text, F.lit(GAP), block["text"]))
        hint = F.coalesce(F.nullif(block["hint"], F.lit("")), F.when(~full, state.hint))
        ready = F.length(text) >= sizes.target
        return F.struct(
            F.when(ready, flushed(done, text, hint)).otherwise(done).alias("done"),
            F.when(ready, "").otherwise(text).alias("text"),
            F.when(~ready, hint).alias("hint"),
        )

    def finish(state: Column) -> Column:
        return merge_tail(flushed(state.done, state.text, state.hint), sizes)

    return F.aggregate(blocks, start, step, finish)


def merge_tail(chunks: Column, sizes: ChunkSizes) -> Column:
    n = F.size(chunks)
    last, previous = F.try_element_at(chunks, F.lit(-1)), F.try_element_at(chunks, F.lit(-2))
    merged = F.struct(F.concat(previous["text"], F.lit(GAP), last["text"]).alias("text"), F.coalesce(last["hint"], previous["hint"]).alias("hint"))
    short = (n >= 2) & (F.length(last["text"]) < sizes.tail)
    return F.when(short, F.concat(F.slice(chunks, 1, F.greatest(n - 2, F.lit(0))), F.array(merged))).otherwise(chunks)


def chunk_id(path: Column, index: Column, text: Column) -> Column:
    """`meth:<path>:<index>:` and 12 digits of the SHA-1 of path, index and the first 120 characters."""
    number = index.cast("string")
    digest = F.substring(F.sha1(F.concat_ws("|", path, number, F.left(text, F.lit(120))).cast("binary")), 1, 12)
    return F.concat_ws(":", F.lit("meth"), path, number, digest)


def chunks_of(blocks: DataFrame, key: str, order: str, text: str, hint: Column, sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """A row a chunk: key, chunk_index, text, section_hint. Blocks without text are left out."""
    gathered = (
        blocks.filter(F.col(text).isNotNull())
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("text"), hint.alias("hint")))).alias("blocks"))
    )
    return exploded(gathered.select(key, pack_blocks(F.transform("blocks", lambda b: F.struct(b["text"].alias("text"), b["hint"].alias("hint"))), sizes).alias("chunks")), key)


def exploded(chunked: DataFrame, key: str) -> DataFrame:
    return chunked.select(key, F.posexplode("chunks").alias("at", "chunk")).select(
        key, F.col("at").cast("long").alias("chunk_index"), F.col("chunk.text").alias("text"), F.col("chunk.hint").alias("section_hint")
    )
