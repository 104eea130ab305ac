"""What Python workers need."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def know_package(spark: SparkSession) -> None:
    """Workers import this package from where the driver has it, unless --py-files brings it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
