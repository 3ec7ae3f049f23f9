import __spark_entry__ as entry


def test_names_and_flagship(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert entry.entry(spark).limit(1).count() == 1
