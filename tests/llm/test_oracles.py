"""Corpus queries against their SQL."""

from __future__ import annotations

import pytest

from tidemark.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, same_rows, sf_dir, name):
    same_rows(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name])
