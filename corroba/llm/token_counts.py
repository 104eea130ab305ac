"""Operator 7: token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the parts that are most frequent in the whole corpus,
with their numbers of ids; tier two is a cache in each worker, filled by the tokenizers
library. No part is shuffled but for the few that each task proposes for tier one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.llm._common import slices, table, text_or_empty
from corroba.llm.tokens import CACHED_CHARS, PartCache, _uneven, part_cache, tokenizer_path

#: Entries of the broadcast table: at most this many parts of CACHED_CHARS characters.
TABLE_ENTRIES = 32_768
#: Parts that one task proposes, and that it counts at once.
PROPOSED, COUNTED = 4_096, 200_000


def _propose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            seen.update(text.split(" ")[1:])
        if len(seen) > COUNTED:
            seen = Counter(dict(seen.most_common(COUNTED // 4)))
    top = [(w, n) for w, n in seen.most_common(PROPOSED) if len(w) <= CACHED_CHARS and not _uneven(w)]
    yield pa.RecordBatch.from_arrays(
        [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["part", "n"]
    )


def frequent_parts(docs: DataFrame, text: str = "text", entries: int = TABLE_ENTRIES) -> list[str]:
    """The parts that tasks over all documents count most often: at most `entries`, whatever
    the corpus. They only decide what is looked up fast, never a result."""
    return [
        r.part
        for r in docs.select(text_or_empty(text).alias("text"))
        .mapInArrow(_propose, "part string, n long")
        .groupBy("part")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "part")
        .limit(entries)
        .collect()
    ]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each; other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    parts = frequent_parts(docs, text)
    counts = PartCache(path, "lengths")._encode(parts) if parts else []
    # parts hold no space, so one string holds them all
    sent = spark.sparkContext.broadcast((" ".join(parts), np.array(counts, dtype="<u2").tobytes()))

    def lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = part_cache(path, "lengths")
        words, n = sent.value
        if words and (len(cache.given) != words.count(" ") + 1 or words.split(" ", 1)[0] not in cache.given):
            cache.give(dict(zip(words.split(" "), np.frombuffer(n, "<u2").tolist())))
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cache.lengths(batch.column(2).to_pylist()), pa.int64())],
                names=["id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(
            F.col(id_col).alias("id"),
            F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"),
            text_or_empty(text).alias("text"),
        )
        .mapInArrow(lengths, f"id {kind}, n_bytes long, n_tokens long")
        .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
