import os

import pytest

import __spark_entry__ as entry
from votewright.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def test_names_and_oracles_agree():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() == len(catalogue.LFS)
