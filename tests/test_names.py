import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgraph.functions import features as FT
from newsgraph.operators import clustering as CL, names as N
from test_kernels import loop_linkage

WORDS = "acme global north labs open data river stone inc the new blue systems group delta cloud".split()


def dense(entries):
    out = np.zeros(FT.DIMENSIONS)
    for bucket, w in entries:
        out[bucket] = w
    return out


def random_points(seed, n, buckets=30, most=6):
    """Unit vectors with random weights, so that no two products tie; many lie close to each other."""
    rng, points = random.Random(seed), []
    while len(points) < n:
        held = {b: rng.random() ** 2 + 0.05 for b in rng.sample(range(buckets), rng.randint(1, most))}
        for _ in range(rng.randint(1, 4)):
            near = {b: w * rng.uniform(0.7, 1.4) for b, w in held.items()}
            if rng.random() < 0.3:
                near[rng.randrange(buckets)] = rng.uniform(0.05, 0.4)
            length = sum(w * w for w in near.values()) ** 0.5
            points.append((len(points), sorted((b, w / length) for b, w in near.items())))
    return points[:n]


def frame(spark, points):
    return spark.createDataFrame(points, "id int, words array<struct<bucket: int, w: double>>").repartition(4)


@pytest.mark.parametrize("bound", [0.3, 0.85])
def test_lists_miss_no_pair(spark, bound):
    rng = random.Random(7)
    # means are no longer than one, and mostly shorter
    points = [(i, [(b, w * rng.choice([1.0, 1.0, 0.9])) for b, w in e]) for i, e in random_points(3, 160)]
    points += [(500, [(4, 1.0)]), (501, [(4, bound)]), (502, [(4, bound), (5, (1 - bound * bound) ** 0.5)]), (503, [(b, 64 ** -0.5) for b in range(64)])]
    rows = frame(spark, points)
    clusters = rows.select(F.col("id").alias("c"), F.map_from_entries("words").alias("m"))
    got = {(r.c, r.other) for r in N.partners(clusters, N.bucket_places(rows, "words"), bound).collect()}
    full = np.array([dense(e) for _, e in points])
    dots = np.round(full @ full.T, 9)
    ids = [i for i, _ in points]
    want = {(ids[a], ids[b]) for a, b in zip(*np.nonzero(dots >= bound - 1e-9)) if a != b}
    assert got == want and len(want) > 20


@pytest.mark.parametrize("bound", [0.7])
def test_linkage_matches_the_loop(spark, bound):
    points = random_points(11, 45)
    points += [(len(points) + i, points[i][1]) for i in range(12)]  # equal rows
    groups = {}
    for r in N.sparse_linkage(frame(spark, points), "id", "words", bound).collect():
        groups.setdefault(r.cluster, set()).add(r.id)
    assert {frozenset(g) for g in groups.values()} == loop_linkage(np.array([dense(e) for _, e in points]), bound)
    assert all(min(g) == c for c, g in groups.items())


def test_names_cluster_as_dense_vectors_do(spark):
    """Names tie often; both ways choose the smaller pair."""
    rng = random.Random(5)
    names = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5))) for _ in range(70)] + ["Inc acme", "acme inc", "ACME, Inc.", "acme acme inc", "", None, "!?"]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    words = N.unit_words(rows, "id", "name")
    got = {r.id: r.cluster for r in N.sparse_linkage(words, "id", "words", 0.85).collect()}
    vectors = spark.createDataFrame([(r.id, dense(r.words).tolist()) for r in words.collect()], "id int, vec array<double>")
    want = {r.id: r.cluster for r in CL.average_linkage(vectors, "id", "vec", 0.85).collect()}
    assert got == want
    assert set(range(70, 74)) <= got.keys() and not {74, 75, 76} & got.keys()
    assert got[70] == got[71] == got[72]


def test_few_candidates_are_met(spark):
    """2,000 names of a frequent word and others: a list holds few of them."""
    rng = random.Random(9)
    words = [f"word{i}" for i in range(1500)]
    names = [(i, " ".join(["inc"] * (i % 3 > 0) + rng.sample(words, rng.randint(1, 4)))) for i in range(2000)]
    rows = N.unit_words(spark.createDataFrame(names, "id int, name string"), "id", "name")
    clusters = rows.select(F.col("id").alias("c"), F.map_from_entries("words").alias("m"))
    lists = N.listed(clusters, N.bucket_places(rows, "words"), 0.85).groupBy("list").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).first()
    assert lists.pairs < 0.01 * 2000 * 1999 / 2


def test_nothing(spark):
    none = spark.createDataFrame([], "id int, name string")
    assert N.sparse_linkage(N.unit_words(none, "id", "name"), "id", "words", 0.85).collect() == []
    with pytest.raises(ValueError):
        N.sparse_linkage(none, "id", "name", 0.0)


def test_entities_without_words_are_alone(spark):
    rows = spark.createDataFrame([("Acme Inc",), ("inc ACME",), ("???",), ("!",), (" ",), (None,), ("acme inc",)], "name string")
    got = {r.k: r.cluster for r in CL.resolve_entities(rows, "name").collect()}
    assert got == {"acme inc": "acme inc", "inc acme": "acme inc", "???": "???", "!": "!"}
