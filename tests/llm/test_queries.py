"""The pN_ queries of the subpackage: twins where there are any, columns and schemas."""

from __future__ import annotations

import pytest
from oracle import compare

from scriptorium.llm.queries import QUERIES
from scriptorium.llm.sql import SQL

COLUMNS = {
    "p1_found": [("id", "string"), ("para_no", "int")],
    "p2_found": [("id_a", "string"), ("id_b", "string")],
    "p4_found": [("id_a", "string"), ("id_b", "string")],
    "p5_found": [("id", "string"), ("shared_chars", "int")],
    "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p8_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_twin(spark, data, name):
    rows, difference = compare(spark, data, QUERIES[name], SQL[name])
    assert not difference and rows > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, data, name):
    frame = QUERIES[name](spark, data)
    assert name not in COLUMNS or frame.dtypes == COLUMNS[name]
    rows = frame.collect()
    assert len(rows) == len({tuple(map(str, r)) for r in rows})
