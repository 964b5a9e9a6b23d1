"""Every query of the library against its SQL on the smallest tables; those without SQL run."""

from __future__ import annotations

import compare
import pytest

from loamline import plans


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_matches_sql(spark, duck, name):
    df = plans.queries()[name](spark, compare.DATA)
    sql = plans.oracle_sql().get(name)
    if sql is None:
        df.collect()
        return
    assert compare.difference(df, duck, sql) == ""


def test_every_sql_has_a_query():
    assert set(plans.oracle_sql()) <= set(plans.queries())
