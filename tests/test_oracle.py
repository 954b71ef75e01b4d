"""Every registered query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import compare

from scriptorium.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_twin(spark, data, name):
    rows, difference = compare(spark, data, QUERIES[name], SQL[name])
    assert not difference
    assert rows > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_twin(spark, data, name):
    frame = QUERIES[name](spark, data)
    assert frame.columns and frame.count() > 0
