"""Every registered query of the library against its SQL, on whole tables."""

from __future__ import annotations

import pytest
from _compare import DATA, compare

from attestry import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], f"{DATA}/sf0.001") is None


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, f"{DATA}/sf0.001").schema.fields
