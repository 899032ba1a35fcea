"""Every registered query against its DuckDB oracle on the smallest scale factor (the driver
runs the same comparison at sf0.01); queries without an oracle must run and return rows."""

import pytest

import __spark_entry__ as E
from pairmatch.plans import catalog
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, name, SF, con, verbose=False)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 20
    assert df.columns == ["topic", "stance", "n_group", "n_top", "ap_strict", "ap_relaxed"]


def test_every_query_has_oracle_or_is_documented():
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"model_scores"}
