"""Stages on a small folder; registered queries on the given tables."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare, connect
from newsgraph.llm import queries

INSULT = "zorgly"


def folder_of(spark, path, docs, labels, bench):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double, items string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def sentence(i):
    import random

    draw = random.Random(i)
    return " ".join(draw.choices([f"{a}{b}" for a in "the was ing er ion st".split() for b in "an or is at en".split()], k=60))


def test_run(spark, tmp_path):
    passage = " ".join(f"bench{i}" for i in range(14))
    docs = [(i, sentence(i) + (f". you {INSULT} you." if i % 6 == 0 else "."), "en") for i in range(240)]
    docs += [(1000, docs[1][1], "en"), (1001, f"{sentence(777)} {passage}", "en"), (1002, None, "en"), (1003, "", "en"), (1004, "12 34", None), (1005, sentence(5000), None)]
    # without a key, of one key, in ties, very long
    docs += [(None, sentence(9001), "en"), (None, sentence(9001), "en"), (None, docs[7][1], "en"), (1010, sentence(9002), "en"), (1010, sentence(9003), "en"),
             (1011, docs[1][1], "en"), (1012, " ".join(sentence(i) for i in range(10_000, 11_500)), "en")]
    labels = [(i, 1, int(i % 6 == 0)) for i in range(240)]
    rows = [(i, t, lang, "src", len(t or ""), 0.5, "x") for i, t, lang in docs]
    path = folder_of(spark, tmp_path / "in", rows, labels, [(1, passage)])
    at, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    names = at.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, at, path).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        assert at.columns == names
        keys = [r.doc_id for r in at.collect()]
        assert keys.count(1010) == 2 and keys.count(1012) == 1 and keys.count(None) == (3 if k < 2 else 1)
        kept.append(set(keys))
    clean = {i for i in range(240) if i % 6} | {1005, 1010, 1012, None}
    assert {i for i in range(240) if i % 6 == 0}.isdisjoint(kept[0]) and clean | {1000, 1001, 1002, 1003, 1004} <= kept[0]
    assert kept[1] == kept[0] - {1002, 1003, 1004}
    assert kept[2].isdisjoint({1000, 1011}) and clean <= kept[2]
    assert kept[3] == kept[2] - {1001}
    final = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in final} == kept[3] and all(r.ids for r in final) and sum(r.doc_id is None for r in final) == 1


def test_empty_tables(spark, tmp_path):
    path = folder_of(spark, tmp_path / "in", [], [], [])
    assert corpus_pipeline.run(spark, path).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, folder, name):
    sql = queries.ORACLE.get(name)
    if sql:
        assert compare(spark, connect(folder), queries.QUERIES[name], sql, folder)[1] == ""
    else:
        assert entry.queries()[name](spark, folder).count() > 0
