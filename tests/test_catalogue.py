"""Every registered query against its SQL twin on the smallest data set."""

import pytest

import __spark_entry__ as contract
from folioscan.plans import load_all
from tools.check import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(load_all()))
def test_query(spark, con, name):
    ok, rows, _, message = compare(spark, con, name, SMALL)
    assert ok, message


def test_catalogue_shape():
    names, twins = set(contract.queries()), set(contract.oracle_sql())
    assert twins <= names and set(load_all()) <= names
    assert set(load_all()) - twins == {"chunk_documents", "stem_vocabulary"}


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["query_id", "doc_id", "lexical_rank", "semantic_rank", "rrf_score", "rank"]
    assert df.count() > 0
