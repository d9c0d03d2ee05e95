import os

import pytest

import __spark_entry__ as e


def test_every_sql_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(e.ENTRY_DIR), reason="no test tables")
def test_entry(spark):
    d = e.entry(spark)
    assert d.columns == ["qid", "vec_id", "rk", "score", "metadata"] and d.count() == 250
