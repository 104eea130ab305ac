"""Reading, scratch tables and Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}


#: Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 8 << 20
_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on this session sends workers no larger batches of rows, so that texts lie in
    memory a few at a time on both sides."""
    if int(spark.conf.get(_KEY).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_KEY, str(BATCH_BYTES))


def tidy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; at the end the worker, which lives on, gives memory back to the system."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    # workers import this package from where the driver has it, unless --py-files brings it
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the cluster's shared folder (spark.checkpoint.dir).

    Only where that setting is absent and the master is local, as in tests, is a temporary
    folder made; on a cluster executors would not see it. The folder goes when the driver's
    Python ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own_dir[app] = f"{base or tempfile.mkdtemp(prefix='corroba-')}/corroba-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _own_dir[app])
    return _own_dir[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    except Exception:  # noqa: BLE001  the session may be gone by now
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later steps neither
    recompute it nor depend on the executors that made it."""
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(column: str, modulus: int):
    """crc32 of an id as text, modulo modulus."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def field_or_empty(rows: pa.StructArray, place: int) -> pa.Array:
    """A string field of rows, empty where it is null: texts go to a worker once, inside their rows."""
    return pc.fill_null(rows.field(place), "")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without nulls."""
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterable[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds little at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def crc32_of_ids(ids_u32) -> int:
    return zlib.crc32(ids_u32.astype("<u4").tobytes())
