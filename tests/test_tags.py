"""Topics and entities stand for every document; the smallest tables have twice as many documents as articles."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect


@pytest.mark.parametrize("name", ["f16_release_topics", "f17_merge_source_entity", "f36_topic_labels", "w12_primary_entity", "j07_distinct_keys"])
def test_documents_without_events_keep_their_tags(spark, folder, name):
    _n, problem = compare(spark, connect(folder), entry.queries()[name], entry.oracle_sql()[name], folder)
    assert problem == ""
