"""The queries of this subpackage that SQL can express, over the smallest tables."""

import os

import pytest

import verify
from factloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_agree_with_their_sql(spark):
    assert verify.compare(spark, SF, {n: f for n, f in queries.QUERIES.items() if n in queries.SQL}, queries.SQL) == []
