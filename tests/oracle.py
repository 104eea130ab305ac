"""Comparing a query with its SQL on the same tables."""

from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return float(value) if isinstance(value, Decimal) else value


def differences(spark, sf_dir, query, sql):
    """Rows that only Spark has and rows that only the SQL has."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = query(spark, sf_dir)
    columns = sorted(found.columns)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    got = Counter(tuple(map(plain, r)) for r in found.select(columns).collect())
    return got - want, want - got
