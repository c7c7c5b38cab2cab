"""Every named query outside the corpus subpackage against its SQL, and the driver entry."""

from __future__ import annotations

import pytest

import __spark_entry__
from tidemark import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, same_rows, sf_dir, name):
    same_rows(catalog.queries()[name](spark, sf_dir), catalog.oracle_sql()[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
