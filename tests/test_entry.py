import __spark_entry__ as entry


def test_names_of_sql_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 40
