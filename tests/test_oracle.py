"""Every registered query against its SQL twin on the smallest shared tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tools.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="shared tables not present")
@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_matches_sql(spark, duck, name):
    ok, note = compare(spark, duck, name, SF_DIR)
    assert ok, note
