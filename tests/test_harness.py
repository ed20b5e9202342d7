"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from harness.check import compare

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert contract.entry(spark).count() == 8


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, name, capsys):
    assert compare(spark, SF, [name]) == 0, capsys.readouterr().out
