"""Search against brute force."""

import numpy as np
from pyspark.sql import functions as F

from newsgraph.llm import ann


def brute(rows, queries, k):
    """rows: {id: vector}."""
    out = {}
    for q in queries:
        pairs = sorted((-float(np.dot(rows[q], v)), i) for i, v in rows.items() if i != q)
        out[q] = [(i, -s) for s, i in pairs[:k]]
    return out


def searched(spark, rows, k, kind="array<float>", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label string")
    found = {}
    for r in sorted(ann.search(df, F.col("vec_id") % 20 == 0, k, **options).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert all([x[0] for x in v] == list(range(1, len(v) + 1)) for v in found.values())
    return {q: [x[1:] for x in v] for q, v in found.items()}


def test_traverse_is_in_order_of_summed_distance():
    draw = np.random.default_rng(1)
    a, b = draw.normal(size=7), draw.normal(size=5)
    sizes = draw.integers(0, 4, 35)
    got = ann.traverse(a, b, sizes, int(sizes.sum()))
    sums = (a[:, None] + b).ravel()
    assert sorted(got) == [c for c in range(35) if sizes[c]] and all(sums[x] <= sums[y] + 1e-12 for x, y in zip(got, got[1:]))
    assert ann.traverse(a, b, sizes, 3) == got[: len(ann.traverse(a, b, sizes, 3))]


def test_recall_on_clustered_vectors(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(30, 16))
    data = (centres[draw.integers(0, 30, 3000)] + 0.3 * draw.normal(size=(3000, 16))).astype(np.float32)
    got = searched(spark, [(i, v.tolist(), "x") for i, v in enumerate(data)], 20, part=200)
    want = brute({i: v.astype(float) for i, v in enumerate(data)}, range(0, 3000, 20), 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    for q, found in got.items():
        for i, s in found:
            assert abs(s - float(np.dot(data[q].astype(float), data[i].astype(float)))) < 1e-9
        assert all(x[1] >= y[1] for x, y in zip(found, found[1:])) and q not in {i for i, _ in found}


def test_copies_ties_and_rows_that_take_no_part(spark):
    e = np.eye(4)
    rows = [(i, e[0].tolist(), "x") for i in range(0, 300)]
    rows += [(1000, e[1].tolist(), "x"), (1001, e[1].tolist(), "x"), (1020, (e[0] + e[1]).tolist(), "x"), (1020, (e[0] + e[1]).tolist(), "y")]
    odd = [(2000, None, "x"), (2020, [0.0] * 4, "x"), (2040, [1.0, None, 0.0, 0.0], "x"), (2060, [float("nan"), 1.0, 0.0, 0.0], "x"), (2080, [float("inf"), 0.0, 0.0, 0.0], "x"),
           (2100, [1.0, 2.0], "x"), (None, [1.0, 0.0, 0.0, 0.0], "x"), (2120, [], "x")]
    data = {i: np.array(v) for i, v, _ in rows}
    got = searched(spark, rows + odd, 5, "array<double>", recall=1.0)
    assert got == brute(data, [i for i in data if i % 20 == 0], 5)


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0, -0.0], "x"), (20, [0.5, 0.5, 0.0], "x"), (3, [-1.0, 0.0, 0.0], "x")]
    assert searched(spark, rows, 20) == brute({i: np.array(v) for i, v, _ in rows}, [0, 20], 20)
    assert searched(spark, rows[:1], 20) == {}
    assert searched(spark, [(0, None, "x")], 20) == {} and searched(spark, rows[2:], 20) == {}
    assert searched(spark, [(0, [2.0], "x"), (1, [3.0], "x"), (2, [-1.0], "x")], 2) == {0: [(1, 6.0), (2, -2.0)]}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(empty, F.col("vec_id") % 20 == 0).count() == 0
