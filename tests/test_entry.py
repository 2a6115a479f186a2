import __spark_entry__ as entry


def test_names_and_flagship(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 140
    assert entry.entry(spark).columns == ["doc_id", "begin", "end", "score"]
