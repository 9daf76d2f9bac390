"""Each query of the core over the smallest tables, against its SQL where it has one."""

import os

import pytest

import verify
from factloom import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_all_queries_agree_with_their_sql(spark):
    assert verify.compare(spark, SF, queries.QUERIES, queries.SQL) == []
