"""Every registered query against its independent SQL answer, on whole tables."""

import pytest

import __spark_entry__ as contract
from compare import connect, differences
from shelfgraph.verification import oracle, registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    return connect(FOLDER)


APPROXIMATE = {"knn_lsh"}  # no exact answer to compare with; its recall is tested with the neighbours


def test_every_exact_query_has_an_answer():
    assert set(oracle.statements()) == set(registry.QUERIES) - APPROXIMATE


def test_the_contract_offers_every_query():
    assert set(registry.QUERIES) <= set(contract.queries()) and set(oracle.statements()) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - APPROXIMATE))
def test_answer(spark, engine, name):
    assert differences(registry.QUERIES[name](spark, FOLDER), engine, oracle.statements()[name]) == []


def test_flagship_has_rows(spark):
    assert not contract.entry(spark).isEmpty()
