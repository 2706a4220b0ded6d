"""The driver's contract."""

import __spark_entry__ as e


def test_names():
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and all(callable(f) for f in q.values())


def test_entry(spark):
    r = e.entry(spark).collect()
    assert [x["method"] for x in r] == ["exact", "normalised", "word"] and r[0]["failures"] >= r[1]["failures"] >= r[2]["failures"]
