"""Fingerprints, links and groups against plain loops."""

import random

import xxhash
from pyspark.sql import functions as F

from newsgraph.llm import common, simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_roots(values):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    ordered = sorted(values)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def test_fingerprint():
    words = [f"w{i % 37}é" for i in range(70_000)]
    for text in (None, "", " \t\n", "one", "One TWO", "a b c", "a b c d a b c d", " ".join(words), "ÀÉ x y z\x0bq"):
        assert simhash.fingerprint(text.encode() if text is not None else None) == plain_fingerprint(text)


def test_every_shingle_of_a_long_text_counts():
    draw = random.Random(3)
    for size in (32_769, 32_770, 32_771, 70_000):
        words = [b"w%d" % draw.randrange(50_000) for _ in range(size)]
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(size - 2)]
        counts, total = simhash.bit_counts(b" ".join(words))
        assert total == size - 2 and counts.tolist() == [sum(h >> b & 1 for h in hashes) for b in range(64)]


def test_spark_hash_is_the_same(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("ein zwei drei"))).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("ein zwei drei".encode(), 42)


def clusters(seed):
    draw, values = random.Random(seed), set()
    for _ in range(12):
        v = draw.getrandbits(64)
        for _ in range(draw.choice([1, 3, 40])):
            values.add(v)
            for _ in range(draw.choice([1, 2, 3])):
                v ^= 1 << draw.randrange(64)
    return sorted(simhash._signed(v) for v in values)


def test_links_connect_exactly_what_is_close(spark):
    for seed, most in ((1, 64), (2, 1), (3, 4)):
        values = clusters(seed)
        df = spark.createDataFrame([(v,) for v in values], "fp long")
        roots = {r.node: r.root for r in common.components(simhash.links(df, most=most)).collect()}
        want = plain_roots(values)
        assert {v: roots.get(v, v) for v in values} == want
        for blocks in (3, 5):
            other = {r.node: r.root for r in common.components(simhash.links(df, blocks=blocks, most=most)).collect()}
            assert other == roots


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 200), (5, 5), (300, 301), (301, 302), (302, 300)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 300, 301: 300, 302: 300}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_and_deduplicate(spark, make_docs):
    base = [f"word{i}" for i in range(400)]
    near = base[:]
    near[200] = "other"
    far = [f"else{i}" for i in range(300)]
    rows = [(9, " ".join(base)), (4, " ".join(base)), (7, " ".join(base).upper()), (12, " ".join(near)), (20, " ".join(far)), (30, None), (31, ""), (32, " \n"),
            (20, " ".join(far)), (None, " ".join(far)), (None, "single words")]
    docs = make_docs(rows, clash=["fp", "component", "first"])
    got = [(r.doc_id, r.fp, r.component) for r in simhash.groups(docs).collect()]
    assert len(got) == len(rows)
    prints = [simhash._signed(plain_fingerprint(t)) for _, t in rows]
    roots = plain_roots(set(prints))
    first = {}
    for (key, _), fp in zip(rows, prints):
        if key is not None:
            first[roots[fp]] = min(first.get(roots[fp], key), key)
    want = sorted(((k, fp, first.get(roots[fp])) for (k, _), fp in zip(rows, prints)), key=str)
    assert sorted(got, key=str) == want
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([4, 20, 20, 30, None] + ([12] if roots[prints[3]] != roots[prints[0]] else []), key=str)
    empty = docs.limit(0)
    assert simhash.groups(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def test_hot_keys_keep_every_row(spark):
    left = spark.range(5000).select((F.col("id") % 3 * F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id"))).alias("k"), "id")
    left = left.unionByName(spark.createDataFrame([(None, -1)], "k long, id long")).cache()
    right = spark.range(0, 6000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = {(r.id, r.v) for r in common.join_unique(left, right, "k").collect()}
    want = {(r.id, r.v) for r in left.join(right, "k", "left").collect()}
    assert got == want and len(got) == 5001
