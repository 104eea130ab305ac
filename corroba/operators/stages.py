"""Stages whose outputs are kept by what they are made of, so that a second run makes only what is missing.

An output lies in a folder named by the stage and a digest of its settings and of the digests of
what it reads. Spark's writer marks a folder as whole when its job commits; one without that
mark is made anew. What a stage read has a digest too, so a change reaches just what depends on it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Part of every digest: outputs of another version of the stages are not taken for these.
VERSION = 1


@dataclass(frozen=True)
class Output:
    """A stage's rows, its digest, and whether this run made it."""

    name: str
    digest: str
    made: bool
    rows: DataFrame


def content_digest(rows: DataFrame) -> str:
    """A digest of the rows, whatever their order: their number and two sums over hashes, in one pass."""
    whole = F.struct(*sorted(rows.columns))
    wide = lambda seed: F.sum(F.xxhash64(whole, F.lit(seed)).cast("decimal(38,0)"))
    return hashlib.sha256(repr(tuple(rows.agg(F.count("*"), wide(1), wide(2)).first())).encode()).hexdigest()


class Store:
    """Outputs in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.told: list[Output] = []

    def _is_whole(self, path: str) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def stage(self, name: str, make: Callable[[], DataFrame], reads: tuple[str | Output, ...] = (), settings: object = None) -> Output:
        """The output of a stage: read, if it is there for these settings and digests, else made."""
        of = [r.digest if isinstance(r, Output) else r for r in reads]
        digest = hashlib.sha256(json.dumps([VERSION, name, settings, of], sort_keys=True, default=repr).encode()).hexdigest()
        path = f"{self.folder}/{name}-{digest[:32]}"
        made = not self._is_whole(path)
        if made:
            make().write.mode("overwrite").parquet(path)
        out = Output(name, digest, made, self.spark.read.parquet(path))
        self.told.append(out)
        return out
