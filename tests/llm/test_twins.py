"""Registered queries of this subpackage on the smallest tables, against their SQL twins or for whole results."""

import pytest

import __spark_entry__ as contract
from folioscan.llm import catalogue
from tools.check import compare, connect

SMALL = "/root/testdata/sf0.001"
TWINS = sorted(n for n, e in catalogue.entries().items() if e.sql)


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", TWINS)
def test_twin(spark, con, name):
    ok, _, _, message = compare(spark, con, name, SMALL)
    assert ok, message


def test_all_are_registered():
    assert set(catalogue.entries()) <= set(contract.queries())
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} <= {q.split("_")[0] for q in contract.queries()}


@pytest.mark.parametrize("name", sorted(set(catalogue.entries()) - set(TWINS) - {"pipeline", "page_languages"}))
def test_one_row_per_document(spark, con, name):
    rows = contract.queries()[name](spark, SMALL).select("doc_id").collect()
    assert sorted(r.doc_id for r in rows) == [r[0] for r in con.execute("select doc_id from documents order by 1").fetchall()]
