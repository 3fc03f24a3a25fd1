"""Every registered query of the engine against its DuckDB SQL."""

import pytest

import lumenark.plans  # noqa: F401
from lumenark import registry
from oracle import connect, duck_rows, spark_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_oracle(spark, sf_dir, con, name):
    columns, rows = spark_rows(registry.QUERIES[name](spark, sf_dir))
    want_columns, want = duck_rows(con, registry.ORACLES[name])
    assert columns == want_columns
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
