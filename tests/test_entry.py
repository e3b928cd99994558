import os

import duckdb
import pytest
from check_oracles import compare, connect

import __spark_entry__ as entry
from shelfwatch.oracles import ORACLES
from shelfwatch.registered import QUERIES

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
# One query per family; CHECK_QUERIES=all runs every one.
SAMPLE = "s_badrows p_whatif p_crit j_notalerted q_overview q_actions w_std7 m_usage v_report l_sessions t_cdc t_sessions"
CHOSEN = os.environ.get("CHECK_QUERIES", SAMPLE)
NAMES = list(entry.oracle_sql()) if CHOSEN == "all" else CHOSEN.split()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    result = entry.entry(spark)
    assert result.columns[:3] == ["organization", "location", "item"]
    assert result.count() > 0


@pytest.fixture(scope="module")
def db() -> duckdb.DuckDBPyConnection:
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, db, name):
    rows, problems = compare(spark, db, FOLDER, name)
    assert not problems
