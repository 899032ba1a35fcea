"""Every registered query of the subpackage runs, and agrees with its DuckDB SQL where it has one."""

import pytest

import __spark_entry__ as E
from oracle import compare, duck
from pairmatch.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    assert compare(spark, name, SF, con, verbose=False)


def test_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries()) and set(queries.ORACLE) <= set(E.oracle_sql())
