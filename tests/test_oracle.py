"""Every registered query against its SQL twin on the driver tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

ORACLES = entry.oracle_sql()
# The training-data operators have their own tests.
CORPUS = {name for reg in entry._corpus_registries() for name in reg.queries}
NAMES = sorted(set(entry.queries()) - CORPUS)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_a_twin():
    assert set(NAMES) == set(ORACLES) - CORPUS


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf_dir, con, name):
    assert compare(entry.queries()[name](spark, sf_dir), con, ORACLES[name]) is None
