"""Joins on containment: which texts hold which passages or words, through hash joins.

A passage that occurs in a text brings its inner words, those between its first and last space,
as whole words of the text. So each passage is looked up by one inner word, its longest, among
the distinct words of the texts, and only what that finds is searched for the passage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Bytes of a side that is broadcast; a larger one goes in shards.
BROADCAST_BYTES = 64 << 20


def shards(side: DataFrame, limit: int | None = None) -> list[DataFrame]:
    """side in parts of about `limit` bytes, each with a broadcast hint."""
    limit = limit or BROADCAST_BYTES
    width = F.lit(32 * len(side.columns))
    for name, kind in side.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
    size = side.agg(F.coalesce(F.sum(width), F.lit(0)).alias("n")).first().n
    n = max(1, -(-size // limit))
    return [F.broadcast(side if n == 1 else side.filter(F.pmod(F.xxhash64(*side.columns), F.lit(n)) == i)) for i in range(n)]


def over_shards(rows: DataFrame, side: DataFrame, on: Column | str, limit: int | None = None) -> DataFrame:
    """rows joined with a side that is broadcast shard by shard."""
    out = None
    for part in shards(side, limit):
        joined = rows.join(part, on)
        out = joined if out is None else out.union(joined)
    return out


def holding(rows: DataFrame, key: str, text: str, passages: DataFrame, passage_key: str, passage: str) -> DataFrame:
    """key, passage_key of each row of rows whose text holds a passage. Keys tell rows apart.
    Null texts and passages hold and are held by nothing; an empty passage is in every text."""
    inner = F.filter(F.slice(F.split("passage", " "), 2, F.greatest(F.size(F.split("passage", " ")) - 2, F.lit(0))), lambda w: w != "")
    # long words are compared by their first characters, so that rows stay narrow
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), F.left(w, F.lit(64)).alias("w"))))["w"]
    asked = passages.select(F.col(passage_key).alias("passage_id"), F.col(passage).alias("passage")).filter("passage IS NOT NULL").withColumn("word", longest)
    given = rows.select(F.col(key).alias("row_id"), F.col(text).alias("held")).filter("held IS NOT NULL")
    words = F.array_distinct(F.transform(F.split("held", " "), lambda w: F.left(w, F.lit(64))))
    candidates = over_shards(given.select("row_id", F.explode(words).alias("word")), asked.filter("word IS NOT NULL"), "word").select("row_id", "passage_id", "passage")
    found = candidates.join(given, "row_id").filter(F.contains("held", F.col("passage"))).select("row_id", "passage_id")
    short = over_shards(given, asked.filter("word IS NULL").drop("word"), F.contains("held", F.col("passage"))).select("row_id", "passage_id")
    return found.union(short).select(F.col("row_id").alias(key), F.col("passage_id").alias(passage_key))


def _grams(text: Column, least: int = 0) -> Column:
    """The distinct runs of 3 characters; below that (from `least` on) those of fewer, too."""

    def runs(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
        return F.filter(every, lambda g: F.length(g) == n)

    kinds = [runs(n) for n in range(max(least, 1), 4)]
    return F.array_distinct(F.concat(*kinds, *([F.array(F.lit(""))] if least == 0 else [])))


def first_containing(rows: DataFrame, key: str, value: str, words: DataFrame, word: str, most: int) -> DataFrame:
    """word, key: for each distinct word the first `most` rows, by key, whose value contains it.

    An inverted index of the values by runs of three characters: each word is looked up by the one
    of its runs that fewest values have, and only what that finds is searched. Words of fewer
    characters are runs themselves. The window's group limit keeps `most` rows of a word before the
    shuffle. An empty word is in every value; null words and values are in and hold nothing. rows and
    words are read several times: kept() what is dear to make."""
    given = rows.select(F.col(key).alias("row_id"), F.col(value).alias("held")).filter("held IS NOT NULL")
    asked = words.select(F.col(word).alias("word")).filter("word IS NOT NULL").distinct()
    shortest = asked.agg(F.min(F.length("word"))).first()[0]
    index = given.select("row_id", F.explode(_grams(F.col("held"), min(3 if shortest is None else shortest, 3))).alias("gram"))
    own = F.when(F.length("word") < 3, F.array("word")).otherwise(_grams(F.col("word"), 3))
    runs = asked.select("word", F.explode(own).alias("gram"))
    frequency = index.join(runs.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # a run that no value has finds nothing, as the word itself would
    rarest = runs.join(frequency, "gram", "left").groupBy("word").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    found = index.join(rarest, "gram").join(given, "row_id").filter(F.contains("held", F.col("word"))).select("word", "row_id")
    place = F.row_number().over(Window.partitionBy("word").orderBy("row_id"))
    return found.withColumn("place", place).filter(F.col("place") <= most).select(F.col("word").alias(word), F.col("row_id").alias(key))


def first_holding(rows: DataFrame, key: str, words: Column, asked: DataFrame, asked_key: str, anchor: str, most: int, least: int = 4) -> DataFrame:
    """asked_key, key, rank: for each asked key the first `most` rows, by key, one of whose words
    holds one of its anchors. An anchor has `least` characters or more, none of which divides words.

    Anchors are compared with distinct words, not with rows: a word meets the anchors that begin with
    one of its pieces of `least` characters. Of each word the first `most` rows are enough."""
    given = rows.select(F.col(key).alias("row_id"), F.explode(F.array_distinct(words)).alias("word")).filter(F.length("word") >= least)
    place = F.row_number().over(Window.partitionBy("word").orderBy("row_id"))
    first = given.withColumn("place", place).filter(F.col("place") <= most).drop("place")
    anchors = asked.select(F.col(asked_key).alias("asked_id"), F.col(anchor).alias("anchor")).distinct()
    starts = anchors.select("anchor", F.left("anchor", F.lit(least)).alias("piece")).distinct()
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - (least - 1)), lambda i: F.substring("word", i, F.lit(least))))
    met = over_shards(first.select("row_id", "word", F.explode(pieces).alias("piece")), starts, "piece").filter(F.contains("word", F.col("anchor"))).select("anchor", "row_id")
    of_anchor = F.row_number().over(Window.partitionBy("anchor").orderBy("row_id"))
    met = met.distinct().withColumn("place", of_anchor).filter(F.col("place") <= most).drop("place")
    hits = met.join(anchors, "anchor").select("asked_id", "row_id").distinct()
    rank = F.row_number().over(Window.partitionBy("asked_id").orderBy("row_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= most).select(F.col("asked_id").alias(asked_key), F.col("row_id").alias(key), F.col("rank").cast("long").alias("rank"))
