import pytest

#: Nulls in any column, blank and very long texts, repeated rows, columns with clashing names.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, id long, n string, path string, part string"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, None, None, "x", 7, "y", "z", None)


@pytest.fixture(scope="session")
def odd(spark):
    rows = [row(1, None), row(2, ""), row(3, " \n\t "), row(4, LONG), row(5, LONG), row(6, "one two"), row(6, "one two"), row(7, "a b c d e f", None), row(8, "é́ \U0001f642 漢字", None), row(None, "a b c d e f")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(sf_dir):
    import pyarrow.parquet as pq

    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
