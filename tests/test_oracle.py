"""Every registered query against its oracle SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
import oracle
from tidemark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert oracle.compare(spark, con, name, contract.queries()[name], contract.oracle_sql()[name], SF) == []


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows_and_columns(spark):
    df = contract.entry(spark)
    assert df.columns == ["entity", "currency", "source_rows", "gold_rows", "source_minor", "gold_minor", "match"]
    rows = df.collect()
    assert len(rows) == 6 and all(r.match for r in rows)
