"""Selection under budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy_budget(rows: DataFrame, key: str, order: list[str], value: str, length: str, most: int | Column, each: int | Column, total: int | Column, largest: int | None = None) -> DataFrame:
    """key, value, place, total: in order, rows are picked while the sum of their lengths (each
    counted up to `each`) stays within `total`; one too long is passed by; at most `most`. The three
    may be columns that are the same in all rows of a key; `largest` is then the most that any key takes.

    Of a key's rows of one length only the first `most` can be picked: once one of them is passed by,
    so are all later ones, as the sum only grows. They are kept by a window whose group limit works
    before the shuffle; so a key, however many rows it has, comes to at most `most` rows for each
    length up to `each`, and these are picked from in one ordered fold."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    limits = F.struct(as_column(most).cast("long").alias("most"), as_column(total).cast("long").alias("total"))
    n = F.least(F.col(length), as_column(each)).cast("long")
    given = rows.select(F.col(key).alias("key"), limits.alias("limits"), n.alias("n"), F.struct(*order).alias("o"), F.col(value).alias("pick")).filter(F.col("n") <= F.col("limits.total"))
    place = F.row_number().over(Window.partitionBy("key", "n").orderBy("o", "pick"))
    # the group limit needs a number
    first = given.withColumn("place", place).filter(F.col("place") <= (most if isinstance(most, int) else largest)).filter(F.col("place") <= F.col("limits.most"))
    items = F.array_sort(F.array_agg(F.struct("o", "n", "pick")))
    gathered = first.groupBy("key").agg(F.first("limits").alias("limits"), items.alias("items"))
    pick_type = rows.schema[value].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast(f"array<struct<pick:{pick_type},total:bigint>>").alias("picked"))

    def step(state: Column, x: Column) -> Column:
        spent = state["spent"] + x["n"]
        fits = (F.size(state["picked"]) < F.col("limits.most")) & (spent <= F.col("limits.total"))
        return F.when(fits, F.struct(spent.alias("spent"), F.concat(state["picked"], F.array(F.struct(x["pick"].alias("pick"), spent.alias("total")))).alias("picked"))).otherwise(state)

    folded = gathered.select("key", F.posexplode(F.aggregate("items", start, step)["picked"]).alias("at", "x"))
    return folded.select(F.col("key").alias(key), F.col("x.pick").alias(value), (F.col("at") + 1).cast("long").alias("place"), F.col("x.total").alias("total"))

