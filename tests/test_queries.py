"""Every named query against its SQL on the smallest data, and the driver contract."""

from __future__ import annotations

import compare
import pytest

from quarrymark.plans.catalogue import CATALOGUE

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(DATA)


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_query(spark, con, name):
    status, _, _, _, note = compare.compare(spark, con, CATALOGUE[name], DATA)
    assert status in ("ok", "rows-only"), note


def test_entry(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    frame = contract.entry(spark)
    assert frame.columns == ["qid", "doc_id", "score", "rank"]
    assert frame.limit(1).count() == 1
