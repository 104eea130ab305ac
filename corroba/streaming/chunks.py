"""Chunking texts as they arrive: a file stream of documents, each packed on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corroba.functions import text as T
from corroba.operators.chunking import ChunkSizes, chunk_id, exploded, pack_blocks


def stream_chunks(documents: DataFrame, key: str = "doc_id", text: str = "text", sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """key, chunk_index, text, section_hint, chunk_id; no state, so late rows need no watermark."""
    blocks = F.transform(T.parts(text, "\n"), lambda x: F.struct(x.alias("text"), F.lit(None).cast("string").alias("hint")))
    chunks = exploded(documents.select(key, pack_blocks(blocks, sizes).alias("chunks")), key)
    return chunks.withColumn("chunk_id", chunk_id(F.col(key).cast("string"), F.col("chunk_index"), F.col("text")))


def run_chunk_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str) -> StreamingQuery:
    """Chunk all Parquet files that lie in source now and were not met before."""
    documents = spark.readStream.schema(schema).parquet(source)
    return stream_chunks(documents).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
