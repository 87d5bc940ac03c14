"""Registered queries next to DuckDB on the smallest tables.

A sample by default; ``SESSIONLAKE_ALL=1`` runs every query that has SQL.
"""

import os

import pytest

from oracle import compare, connect

from sessionlake import catalog

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "line_numbers", "integrity_report", "message_table", "session_summaries", "compare_copies", "sync_plan", "import_plan",
    "session_listing", "sync_all_plan", "migrate_plan", "unlink_plan", "account_histories", "newest_sessions", "relink_scan", "title_candidates", "sessions_by_title", "project_dirs", "snapshot_manifest", "native_rows",
    "file_lines", "file_listing", "block_messages", "account_list", "repaired_records",
)
NAMES = sorted(catalog.oracle_sql()) if os.environ.get("SESSIONLAKE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    return connect(SF)


def test_every_statement_belongs_to_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    assert compare(catalog.queries()[name](spark, SF), duck, catalog.oracle_sql()[name]) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
