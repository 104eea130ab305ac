"""Which of many patterns occur in texts: one automaton for all of them, one pass a text."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroba.operators.workers import know_package

#: Bytes of patterns that one automaton has; more go in shards, each a pass over the texts.
SHARD_BYTES = 8 << 20
_built: dict[str, tuple] = {}


def _automaton(sent) -> tuple:
    """(automaton or None, numbers of empty patterns): built once a worker process."""
    import ahocorasick

    name, patterns = sent.value
    if name not in _built:
        places: dict[str, list[int]] = {}
        for i, p in enumerate(patterns):
            places.setdefault(p, []).append(i)
        empty = places.pop("", [])
        machine = None
        if places:
            machine = ahocorasick.Automaton()
            for p, numbers in places.items():
                machine.add_word(p, numbers)
            machine.make_automaton()
        _built.clear()
        _built[name] = machine, empty
    return _built[name]


def _scan(batches: Iterable[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    machine, empty = _automaton(sent)
    for batch in batches:
        found = []
        for text in batch.column(1).to_pylist():
            seen = set()
            if text is not None:
                seen.update(empty)
                for _, numbers in machine.iter(text) if machine else ():
                    seen.update(numbers)
            found.append(sorted(seen))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["row", "hits"])


def with_hits(rows: DataFrame, text: Column, patterns: list[str]) -> DataFrame:
    """All columns of rows with hits: the numbers of the patterns (a short list, from 0) that occur in
    the text, ascending. A null text has none; an empty pattern is in every text."""
    know_package(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, list(patterns)))
    given = rows.select(F.struct("*").alias("row"), text.alias("text"))
    schema = given.select("row", F.lit(None).cast("array<int>").alias("hits")).schema
    return given.mapInArrow(lambda b: _scan(b, sent), schema).select("row.*", "hits")


def occurrences(rows: DataFrame, key: str, text: Column, patterns: DataFrame, pattern_key: str, pattern: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """key, pattern_key of each row whose text has a pattern, patterns being a table of any size:
    they are dealt to automata of about shard_bytes. Null texts and patterns have and are nothing."""
    known = patterns.select(F.col(pattern_key).alias("id"), F.col(pattern).alias("p")).filter("p IS NOT NULL")
    size = known.agg(F.coalesce(F.sum(F.octet_length("p") + 16), F.lit(0)).alias("n")).first().n
    shards = max(1, -(-size // shard_bytes))
    given = rows.select(F.col(key).alias("row"), text.alias("text"))
    kinds = f"row {rows.schema[key].dataType.simpleString()}, hits array<int>"
    out = None
    know_package(rows.sparkSession)
    for shard in range(shards):
        part = [(r.id, r.p) for r in known.filter(F.pmod(F.xxhash64("id", "p"), F.lit(shards)) == shard).collect()]  # about shard_bytes
        sent = rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [p for _, p in part]))
        ids = F.broadcast(rows.sparkSession.createDataFrame([(i, x) for i, (x, _) in enumerate(part)], f"hit int, id {patterns.schema[pattern_key].dataType.simpleString()}"))
        found = given.mapInArrow(lambda b, sent=sent: _scan(b, sent), kinds).select("row", F.explode("hits").alias("hit")).join(ids, "hit").select(F.col("row").alias(key), F.col("id").alias(pattern_key))
        out = found if out is None else out.unionByName(found)
    return out
