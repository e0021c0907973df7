"""Every registered query beside its SQL twin."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    problem = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert problem in ("", "no rows"), problem


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["source", "month"]
    assert df.count() > 0


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
