"""The driver contract."""

import os

import pytest

import __spark_entry__ as contract
from paravane import queries as engine


def test_names():
    names, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(names) and set(engine.queries()) <= set(names) and "flagship_summary" in sql


@pytest.mark.skipif(not os.path.isdir(contract.SMOKE_DIR), reason="needs the driver's tables")
def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 12 and df.columns[:3] == ["dataset", "model_id", "n"]
