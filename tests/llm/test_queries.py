"""Every query of the subpackage against its SQL, or at least run."""

from __future__ import annotations

import pytest

from rankloom.llm.catalog import QUERIES, SQL
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, same):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    folder = DATA.parent / "sf0.01" if name == "p10_found" else DATA  # the smallest data has no positive label that repeats
    assert QUERIES[name](spark, str(folder)).count() > 0
