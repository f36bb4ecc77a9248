"""Maximal marginal relevance over a bounded pool per reader."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsgraph.operators.ranking import top_per_group


def mmr(
    ranked: DataFrame, vectors: DataFrame | dict, groups: list[str], key: str, score: str, limit: int,
    weight: float = 0.8, pool: int | None = None,
) -> DataFrame:
    """Greedy selection, weight * score - (1 - weight) * largest similarity to the chosen ones.

    (groups, key, pick).  The pool is the first ``pool`` rows per group by score (2 * limit unless
    given), so one group is a bounded task; rows without a vector drop out.  Vectors join after the cut;
    a dict of a bounded number of vectors by key is broadcast instead, and no vector is shuffled.  Of a reader's pool only
    rows are compared that can still be picked: as long as one of the first ``limit`` is left, its value is at least
    weight * score - (1 - weight) * the largest product, which a row further down must beat.
    """
    size = pool or 2 * limit
    candidates = top_per_group(ranked.select(*groups, key, score), groups, [F.desc(score), F.asc(key)], size)
    if isinstance(vectors, dict):
        shared = ranked.sparkSession.sparkContext.broadcast((
            {k: i for i, k in enumerate(vectors)}, np.array(list(vectors.values()), dtype=np.float64).reshape(len(vectors), -1)))
        staged = candidates
    else:
        shared = None
        staged = candidates.join(vectors.select(key, "embedding"), key)
    fields = ", ".join(f"`{n}` {ranked.schema[n].dataType.simpleString()}" for n in groups + [key])

    def choose(table: pa.Table) -> pa.Table:
        """The reader's rows best first; below a margin under the last that the limit reaches by score, none can be picked."""
        keys, scores = np.array(table.column(key).to_pylist()), table.column(score).to_numpy()
        order = np.lexsort((keys, -scores))
        if shared is not None:
            place = np.array([shared.value[0].get(k, -1) for k in keys.tolist()])
            order = order[place[order] >= 0]
            matrix = shared.value[1][place[order]]
        else:
            matrix = np.array(table.column("embedding").to_pylist(), dtype=np.float64)[order]
        scores = scores[order].astype(np.float64)
        if len(order) > limit:
            widest = (matrix * matrix).sum(axis=1).max()  # no product of two of them is larger
            live = scores >= scores[limit - 1] - 2 * (1 - weight) / weight * widest - 1e-6
            order, scores, matrix = order[live], scores[live], matrix[live]
        left = np.ones(len(order), dtype=bool)
        nearest = np.full(len(order), -np.inf)
        picks = []
        while left.any() and len(picks) < limit:
            value = scores if not picks else np.round(weight * scores - (1 - weight) * nearest, 9)
            best = int(np.argmax(np.where(left, value, -np.inf)))
            picks.append(best)
            left[best] = False
            nearest = np.maximum(nearest, matrix @ matrix[best])
        return table.select([*groups, key]).take(pa.array(order[picks] if picks else [], pa.int64())).append_column(
            "pick", pa.array(np.arange(1, len(picks) + 1), pa.int32()))

    return staged.groupBy(*groups).applyInArrow(choose, f"{fields}, pick int")
