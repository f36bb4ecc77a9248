"""Nearest neighbours found in single precision and settled in double, block by block."""

import numpy as np
from pyspark.sql import functions as F

from newsgraph.operators import vectors as V


def loop(probes, homes, k, floor, ids=None):
    near = np.round(probes @ homes.T, 9)
    if ids is not None:
        np.fill_diagonal(near, -3.0)
    out = []
    for row in range(len(probes)):
        order = sorted(range(len(homes)), key=lambda j: (-near[row, j], j))[:k]
        out += [(row, j, near[row, j]) for j in order if near[row, j] >= max(floor, -2.0)]
    return out


def test_ties_beyond_single_precision_are_settled_in_double(monkeypatch):
    monkeypatch.setattr(V, "STRIP", 50), monkeypatch.setattr(V, "TILE", 70), monkeypatch.setattr(V, "HELD", 2000)
    draw = np.random.default_rng(4)
    # groups of vectors that differ by less than single precision tells apart, and ones that do not differ but in length
    heads = np.repeat(draw.normal(size=(12, 16)), 30, axis=0)
    spread = heads + draw.normal(size=heads.shape) * np.repeat([1e-8, 1e-7, 1e-5, 0.0, 0.3, 1.0], 60)[:, None]
    points = V.unit(spread * draw.uniform(0.5, 2, size=(360, 1)))
    points[7] = 0.0
    ids = np.arange(len(points))
    for k, floor in ((1, -2.0), (5, -2.0), (5, 0.4), (400, -2.0)):
        for own in ((ids, ids), ()):
            got = list(zip(*(x.tolist() for x in V.best_homes(points, points, k, floor, *own))))
            want = loop(points, points, k, floor, ids if own else None)
            want = [w for w in want if not (own and w[0] == w[1])]
            assert got == want


def test_a_row_is_copied_once_a_group_of_cells(spark, monkeypatch):
    monkeypatch.setattr(V, "CHUNK", 64), monkeypatch.setattr(V, "BLOCK_NUMBERS", 128 * 24)
    draw = np.random.default_rng(3)
    points = V.unit(draw.normal(size=(1000, 24)))  # spread evenly: every row probes every cell
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vec array<double>")
    pivots = V.choose_pivots(rows, "vec")
    groups = V._groups(rows, "vec", pivots)
    assert len(pivots) == 64 and 8 <= len(set(groups.tolist())) <= 12
    cells = V._with_cells(rows, "vec", pivots, None, 5, groups)
    assert cells.select(F.max(F.size("probes"))).first()[0] <= 12 and cells.filter("not array_contains(probes, home)").isEmpty()
    got = sorted((r.id, r.neighbour) for r in V.neighbours(rows, "id", "vec", 4).collect())
    assert got == sorted((r, j) for r, j, _s in loop(points, points, 4, -2.0, range(1000)))
