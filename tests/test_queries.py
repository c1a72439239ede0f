"""The registry itself, and a cross-section of queries next to their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check

CROSS_SECTION = [
    "text_scalars", "chunk_ids", "exact_duplicates", "near_duplicates", "normalize_dates", "auto_folder", "bm25_topk", "hybrid_retrieve",
    "list_documents_page", "folder_descendants", "merkle_roots", "delta_stats", "job_backoff", "conversation_history", "supersedes_links",
]


@pytest.fixture(scope="module")
def database(small):
    made = duckdb.connect()
    for name in check.TABLES:
        made.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return made


def test_registry():
    own = set(entry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries()) and own <= set(entry.queries()) and len(own) >= 60
    assert own - set(entry.oracle_sql()) == {"chunk_documents", "summary_tree", "stream_indexing"}


@pytest.mark.parametrize("name", CROSS_SECTION)
def test_query_equals_its_sql(spark, small, database, name):
    frame = entry.queries()[name](spark, small)
    ours = check.rows_of(frame.columns, frame.collect())
    result = database.sql(entry.oracle_sql()[name])
    assert ours == check.rows_of(result.columns, result.fetchall())
