"""Tables that several steps read, written once to the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A folder of this application where spark.checkpoint.dir points; a temporary one only where that
    is unset on a single machine, as in tests. It goes with the driver."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _folders[app] = f"{base or tempfile.mkdtemp(prefix='corroba-')}/kept-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone by now
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows, computed once (a checkpoint computes them twice) and read back: what follows depends
    neither on how they were made nor on the executors that made them."""
    path = f"{folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
