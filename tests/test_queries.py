"""Every registered query against its SQL twin on the smallest data folder."""

import re

import pytest
from compare import check, make_duck

from fieldloom import catalog

SF_DIR = "/root/testdata/sf0.001"
QUERIES, TWINS = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return make_duck(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert check(spark, duck, SF_DIR, name, QUERIES[name], TWINS.get(name)) is None


def test_only_unsayable_queries_have_no_twin():
    missing = set(QUERIES) - set(TWINS)
    assert missing == {
        "page_markdown", "entity_candidates", "run_extraction", "profile_html",
        "outage_episodes", "stream_outages",
    }


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_columns_are_plain_names():
    assert all(re.fullmatch(r"[a-z_]+", n) for n in QUERIES)
