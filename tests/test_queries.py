import pytest
from oracle import differences

from corroba.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    only_spark, only_sql = differences(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])
    assert not only_spark and not only_sql


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    def rows(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return [sorted(map(str, QUERIES[q](spark, sf_dir).collect())) for q in ("greedy_chunks", "ordered_notes", "support_id_sets")]

    first, second = rows(2), rows(7)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert first == second
