"""Verdicts, planes, echoes and samples on small rows."""

from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from newsgraph.operators import copies, evaluate as EV, graph as G, vectors as V
from newsgraph.operators.diversity import mmr
from newsgraph.functions import features as FT


def test_the_last_verdict_of_a_pair_counts(spark):
    rows = [("g", "b", "a", "unrelated", 0.9, "first", 1), ("g", "a", "b", "reaction", 0.8, "last", 2), ("g", "a", "c", "follow-up", 0.7, "only", 1)]
    verdicts = spark.createDataFrame(rows, "graph_id string, source string, target string, label string, confidence double, explanation string, reply_no int")
    got = {(r.source, r.target): (r.label, r.explanation) for r in G.latest_verdicts(verdicts).collect()}
    assert got == {("a", "b"): ("reaction", "last"), ("a", "c"): ("follow-up", "only")}
    edges = spark.createDataFrame(
        [("g", "a", "b", "shared-entity", 0.5, 0.6, ["X"], False, 0.1, ["Shared entities: X"], 1)],
        "graph_id string, source string, target string, edge_type string, score double, embedding_similarity double, shared array<string>, event_chain boolean, "
        "topic_similarity double, evidence array<string>, pos int")
    fused = {(r.source, r.target): r for r in G.fuse_verdicts(edges, verdicts).collect()}
    assert len(fused) == 2
    assert fused["a", "b"].evidence == ["Shared entities: X", "Judged reaction 80%"] and fused["a", "b"].explanation == "last" and fused["a", "b"].shared == ["X"]
    assert fused["a", "c"].edge_type == "follow-up" and fused["a", "c"].evidence == ["Judged follow-up 70%"]


def test_each_graph_has_its_own_plane(spark):
    draw = np.random.default_rng(0)
    data = {g: draw.normal(size=(n, 5)) * scale for g, n, scale in (("a", 12, 1.0), ("b", 7, 50.0), ("c", 2, 1.0), ("d", 1, 1.0))}
    rows = [(g, i, v.tolist()) for g, m in data.items() for i, v in enumerate(m)]
    got = {}
    for r in V.planes(spark.createDataFrame(rows, "g string, k long, v array<double>"), "g", "k", "v").collect():
        got.setdefault(r.g, {})[r.k] = (r.x, r.y)
    for g, m in data.items():
        unit = m / np.linalg.norm(m, axis=1, keepdims=True)
        points = np.array([got[g][i] for i in range(len(m))])
        assert points.shape == (len(m), 2) and (points >= 0).all() and (points <= 1).all()
        if len(m) > 2:
            centred = unit - unit.mean(0)
            left, sizes, _ = np.linalg.svd(centred, full_matrices=False)
            for axis in range(2):
                want = left[:, axis] * sizes[axis]
                want = (want - want.min()) / np.ptp(want)
                assert np.allclose(points[:, axis], want) or np.allclose(points[:, axis], 1 - want)
    assert got["c"] == {0: (1.0, 0.0), 1: (0.0, 0.0)} and got["d"] == {0: (0.0, 0.0)}


def test_block_ratio_is_the_sequence_matchers(spark, folder):
    texts = [r.t for r in spark.read.parquet(f"{folder}/documents.parquet").selectExpr("substr(text, 1, 240) as t").orderBy("doc_id").limit(100).collect()]
    texts = texts[:70] + [t[:100] + u[:90] for t, u in zip(texts, texts[1:])][:24] + ["", None, "a", "ab" * 150, "ba" * 150, "é" * 20]
    n = len(texts)
    pairs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, a string").crossJoin(spark.createDataFrame([(j, t) for j, t in enumerate(texts)], "j int, b string"))
    want = {(i, j): SequenceMatcher(None, x or "", y or "").ratio() for i, x in enumerate(texts) for j, y in enumerate(texts)}
    for above in (-1.0, 0.6):
        got = {(r.i, r.j): r.ratio for r in copies.block_ratio(pairs.repartition(8), "a", "b", above).collect()}
        assert n * n == 10_000 and got == {k: v for k, v in want.items() if v > above}
    # reordered text is where it departs from the shingle sets
    one, two = "The first half of the story came over the wire.", "Its sequel, quite another matter, kept us busy."
    rows = [("c", 1, one + two), ("c", 2, two + one)]
    frame = spark.createDataFrame(rows, "cluster_id string, article_id long, text string")
    assert copies.echo_pairs(frame).count() == 0 and copies.echo_pairs(frame, blocks=False).count() == 1


def test_echoes(spark):
    wire = "The agency text that many papers print word for word on the day that it arrives."
    rows = [("a", 1, wire), ("a", 2, wire + " 2"), ("a", 3, "Entirely different words stand here, of another story."), ("b", 4, "ab"), ("b", 5, "ab"), ("b", 6, ""), ("b", 7, None), (None, 8, wire)]
    got = {r.article_id: r.ratio for r in copies.echo_pairs(spark.createDataFrame(rows, "cluster_id string, article_id long, text string")).collect()}
    assert set(got) == {2, 5} and got[5] == 1.0 and 0.9 < got[2] < 1


def test_pair_samples(spark):
    rows = [(i, ["E%d" % (i // 2)] if i < 6 else [], "A" if i in (7, 8) else "OTHER") for i in range(12)]
    clusters = spark.createDataFrame(rows, "cluster_id long, entities array<string>, event_type string")
    got = {(r.a, r.b): (r.why, r.related) for r in EV.pair_samples(clusters, "s").collect()}
    assert len(got) == 10 and {k for k, v in got.items() if v[1]} == {(0, 1), (2, 3), (4, 5)}
    assert got[7, 8] == ("A", None) and sum(v == ("random", False) for v in got.values()) == 6
    stats = spark.createDataFrame([(i, 2 if i < 3 else 1, i) for i in range(6)], "cluster_id long, coverage_count long, last_seen long")
    assert [r.cluster_id for r in EV.recent_clusters(stats).collect()] == [5, 4, 3, 2, 1, 0]
    assert [r.cluster_id for r in EV.recent_clusters(stats, least=3).collect()] == [2, 1, 0]


def test_aliases_of_any_length(spark):
    text = "One two three four five six seven met six seven and One two."
    aliases = spark.createDataFrame([("one two three four five six seven", "Long"), ("six seven", "Short"), ("one two", "Pair"), ("absent", "None")], "alias string, canonical string")
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, t string")
    got = {r.entity: round(r.weight, 6) for r in FT.entity_mentions(docs, "id", "t", aliases).collect()}
    assert got == {"Pair": 0.4, "Short": 0.4, "Long": 0.2}


def test_mmr_with_a_broadcast_pool_equals_the_join(spark):
    draw = np.random.default_rng(3)
    vectors = {i: v.tolist() for i, v in enumerate(draw.normal(size=(30, 8)))}
    ranked = spark.createDataFrame([(u, i, float(draw.uniform(0, 100))) for u in range(3) for i in range(0, 40, u + 1)], "user_id long, article_id long, score double")
    table = spark.createDataFrame(list(vectors.items()), "article_id long, embedding array<double>")
    a = {tuple(r) for r in mmr(ranked, table, ["user_id"], "article_id", "score", 5).collect()}
    b = {tuple(r) for r in mmr(ranked, vectors, ["user_id"], "article_id", "score", 5).collect()}
    assert a == b and len(a) == 15
