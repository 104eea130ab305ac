"""A training-corpus pipeline over `documents`: language ID, near-dedup, decontamination,
secret removal, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame; it works on all that its predecessor kept
and, but for the last, returns the columns of documents. run() writes each stage's rows as
Parquet to the cluster's shared folder and reads them again as the next one's docs.

All stages: rows may be repeated, have nulls in any column and further columns of any name,
which are kept; an empty table gives an empty result. What each makes of null, empty and very
long texts is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.llm import decontaminate, langid, minhash, packing, secrets
from corroba.llm._common import materialise, table
from corroba.llm.tokens import tokenizer_path


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that language ID rejects go.

    Null and empty texts and texts without a letter are rejected; long texts are read whole.
    Models are learned from the labelled documents; where no document has a label, nothing
    can be told and every document stays.
    """
    models = langid.fit(docs.select("doc_id", "text", "lang"), F.lit(True))
    return docs if models is None else langid.identify(docs, models).filter("NOT rejected").select("doc.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id.

    Texts that are null or have no word are no copies of each other; all stay, as do rows
    without an id. Rows of one id are one document and go or stay together.
    """
    return minhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null and empty texts hold none."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; every secret found in their texts is replaced by its kind. Null texts stay
    null; n_chars of a changed text is the new one's."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token ids, with their places in sequences. Null and empty
    texts are a piece of one id, the end; repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", known_languages),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: Models, MinHash and tokenizers are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
