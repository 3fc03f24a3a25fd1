"""Queries of this subpackage that SQL can express, against DuckDB over whole tables."""

import pytest

from lumenark.llm.oracles import ORACLES
from lumenark.llm.queries import queries
from oracle import connect, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, sf_dir, name):
    columns, rows = spark_rows(queries()[name](spark, sf_dir))
    want_columns, want = duck_rows(connect(sf_dir), ORACLES[name])
    assert columns == want_columns
    assert rows == want
