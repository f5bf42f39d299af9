"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as contract
import oracle_check
from moodtide.plans import oracle
from moodtide.plans.queries import REGISTRY

SMALL = "/root/testdata/sf0.001"
# post ids only reach eight digits with more events
LARGER = {"page_posts", "stream_ingest", "ingest_counters", "purge_dirty_ids"}


def directory(name):
    return "/root/testdata/sf0.01" if name in LARGER else SMALL


@pytest.fixture(scope="module")
def connections():
    return {d: oracle_check.connect(d) for d in {SMALL, directory("page_posts")}}


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, connections, name):
    sf_dir = directory(name)
    ok, note = oracle_check.compare(spark, connections[sf_dir], name, sf_dir)
    assert ok, note


def test_every_query_has_sql():
    assert set(REGISTRY) == set(oracle.build())
    assert set(REGISTRY) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 3
