"""Driver contract of __spark_entry__ (no Spark needed)."""

import __spark_entry__ as E


def test_oracle_keys_are_registered_queries():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 50 and len(sql) >= 47


def test_every_query_is_documented_and_sql_is_select():
    for name, fn in E.queries().items():
        assert fn.__doc__ and fn.__doc__.strip(), name
    for name, text in E.oracle_sql().items():
        assert text.lstrip().upper().startswith(("WITH", "SELECT")), name
        assert "CROSS JOIN" not in text.upper(), name
