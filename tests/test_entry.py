import __spark_entry__ as entry


def test_registered():
    names = entry.queries()
    assert "vector_topk" in names and set(entry.oracle_sql()) <= set(names)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
