"""A sample of the registered queries against their SQL at the smallest scale."""

import pytest

from checks import compare, load

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "corpus_overview", "list_memories", "related_compressed", "token_stats", "failure_stats", "remember_outcomes",
    "recall_search", "log_facts", "plain_text_selection", "top_messages", "event_value_percentiles", "cache_misses",
    "chunk_plain", "stream_token_stats", "compression_gate",
]


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    queries, oracles = load()
    report = compare.compare(spark, con, name, queries[name], oracles[name], SF)
    assert report.startswith("OK"), report


def test_every_oracle_has_a_query():
    queries, oracles = load()
    assert set(oracles) <= set(queries)
