import __spark_entry__ as entry


def test_every_sql_has_a_query():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 60


def test_flagship(spark):
    assert 0 < entry.entry(spark).first()[0] <= 1
