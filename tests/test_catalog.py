"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from spanweave import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("part", "documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(str(v) for v in r) for r in df[cols].astype(object).where(df[cols].notna(), None).values.tolist())


@pytest.mark.parametrize("name", ["ngram_occurrences", "document_ngram_counts", "frequency_labels", "all_labels", "child_cover", "partition_static", "joined_partitions", "completed_splits", "reconstruct_texts", "search_trace", "read_decomposition", "backoff", "semantic_distance", "word_ngrams", "event_ngrams", "streaming_counts", "count_histogram", "insert_texts", "insert_grammar", "rule_union", "example_graphs", "vocab_widest_first", "most_frequent_ngrams", "shared_ngrams", "wrapper_ranges", "joined_patterns", "read_sequences", "parsed_types", "ngram_postings", "search_places", "streaming_labels", "event_labels", "event_rules", "document_short_labels"])
def test_against_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
