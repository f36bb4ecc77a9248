"""A cross-section of the registered queries against SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SAMPLE = [
    "f04_url_key", "f08_event_type", "f15_topic_distribution", "f22_blurb", "f28_topic_chips", "c11_importance", "c18_trust_score",
    "c23_verification_state", "c25_verdict_parsing", "d01_admission", "d02_match_by_url", "a01_cluster_stats", "a08_topic_trends",
    "w04_source_cap", "w05_category_interleave", "w11_cluster_articles", "k04_nearest_neighbours", "k10_relationship_edges",
    "s02_rss_items", "s07_github_repos", "s17_digest_artifacts", "s05_feed_log", "t01_feed_log", "t03_stream_dedup", "t05_alert_once", "t06_five_minute_buckets", "e04_summary",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, folder, name):
    _n, problem = compare(spark, connect(folder), entry.queries()[name], entry.oracle_sql()[name], folder)
    assert problem == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
