from __future__ import annotations

import __spark_entry__
from newsloom.plans import catalog


def test_contract(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and set(catalog.QUERIES) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0
