import waypost
from __spark_entry__ import entry, oracle_sql, queries


def test_public_names_exist():
    assert all(hasattr(waypost, name) for name in waypost.__all__)


def test_every_check_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    rows = entry(spark).collect()
    assert sum(r.requests for r in rows) == 200
