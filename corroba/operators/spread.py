"""Tables of few or uneven partitions for work that is dear row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task gets, about; where rows are dear, some ten seconds of work.
ROWS = 100_000


def spread(rows: DataFrame) -> DataFrame:
    """rows, a scan with narrow steps only, in tasks of about ROWS rows and over all cores at least. The
    number of a file's partitions tells nothing: its rows lie in a few groups that can't be cut, all in
    one of the partitions maybe. So rows are counted by partition (of a scan: from the footers, no
    column is read), and stay where they are if no partition has more than twice its share. Select
    the columns that are wanted before."""
    counted = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count").alias("largest"), F.sum("count").alias("all")).first()
    if not counted["all"]:
        return rows
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-counted["all"] // ROWS))
    return rows.repartition(tasks) if counted["largest"] > 2 * -(-counted["all"] // tasks) else rows
