import pytest

import __spark_entry__ as contract
from oracle_compare import connect, differences
from siftwork.plans import views
from siftwork.plans.oracles import ORACLES
from siftwork.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_every_query_has_an_expected_answer():
    assert set(QUERIES) == set(ORACLES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 5


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_sql(spark, db, name):
    assert differences(spark, db, FOLDER, name) is None


# Queries whose answer depends on which line, commit or reference comes first.
ORDERED = (
    "log_top_patterns", "log_summary", "doc_line_dedupe", "build_top_patterns", "build_digest", "test_failure_lines",
    "test_summary_lines", "todo_summary", "recent_commits", "project_edges", "remove_lines", "env_entries",
    "last_good_config_table", "fill_templates",
)


@pytest.mark.parametrize("name", ORDERED)
def test_answer_does_not_depend_on_the_partitioning(spark, db, name, monkeypatch):
    plain = views.table
    monkeypatch.setattr(views, "table", lambda s, folder, table: plain(s, folder, table).repartition(7))
    assert differences(spark, db, FOLDER, name) is None
