"""Approximate nearest neighbours by inner product through an inverted multi-index."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from newsgraph.session import cut_lineage

from .common import join_unique

#: Centroids of each half; the index has as many cells as pairs of them.
CENTROIDS = 32
#: Rows that the centroids are fitted on: those of smallest key hash.
SAMPLE = 20_000
#: Share of true neighbours that the calibration queries have to meet.
RECALL = 0.95
#: Calibration queries, searched against all rows.
CALIBRATION = 128
#: Entries and queries that one task holds; more are dealt to several tasks.
PART = 4_096


def usable(vec: Column, size: int) -> Column:
    """True for a vector of ``size`` finite components, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vec) == size) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def dimension(rows: DataFrame, vec: str) -> int:
    """The most frequent length of the vectors, the larger one of equals; 0 if there are none."""
    found = rows.filter(F.size(vec) > 0).groupBy(F.size(vec).alias("size")).count().agg(F.max(F.struct("count", "size")).alias("m")).first()["m"]
    return found["size"] if found else 0


def _centroids(data: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """k-means; fewer centroids where there are fewer distinct points."""
    points = np.unique(data, axis=0)
    centres = points[np.random.default_rng(5).permutation(len(points))[:count]].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * data @ centres.T).argmin(1)
        held = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, data)
        centres[held > 0] = sums[held > 0] / held[held > 0, None]
    return centres


def traverse(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, candidates: int) -> list[int]:
    """Cells in order of the summed distances of their two centroids until they hold ``candidates`` vectors.

    A heap holds the frontier: after the pair (i, j) of the two sorted lists come (i + 1, j) and (i, j + 1), each once
    both its predecessors are out.  All cells come out if they hold fewer vectors.
    """
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, done, found, total = [(left[a[0]] + right[b[0]], 0, 0)], set(), [], 0
    while heap and total < candidates:
        _, i, j = heapq.heappop(heap)
        done.add((i, j))
        cell = int(a[i]) * len(right) + int(b[j])
        if sizes[cell]:
            found.append(cell)
            total += int(sizes[cell])
        if i + 1 < len(a) and (j == 0 or (i + 1, j - 1) in done):
            heapq.heappush(heap, (left[a[i + 1]] + right[b[j]], i + 1, j))
        if j + 1 < len(b) and (i == 0 or (i - 1, j + 1) in done):
            heapq.heappush(heap, (left[a[i]] + right[b[j + 1]], i, j + 1))
    return found


def _best(scores: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``count`` largest scores of each row, with all that equal the last of them."""
    if scores.shape[1] <= count:
        return tuple(x.ravel() for x in np.indices(scores.shape))
    least = np.partition(scores, scores.shape[1] - count, axis=1)[:, scores.shape[1] - count]
    return np.nonzero(scores >= least[:, None])


class Index:
    """Centroids of the two halves; cell (i, j) lies in block i."""

    def __init__(self, data: np.ndarray, centroids: int):
        self.size, self.half = data.shape[1], (data.shape[1] + 1) // 2
        self.halves = [_centroids(x, centroids) if x.shape[1] else np.zeros((1, 0)) for x in (data[:, : self.half], data[:, self.half :])]
        self.blocks, self.width = map(len, self.halves)

    def matrix(self, column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten(), np.float64).reshape(-1, self.size)

    def parts(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return data[:, : self.half], data[:, self.half :]

    def cells(self, data: np.ndarray) -> np.ndarray:
        i, j = (((c**2).sum(1) - 2 * x @ c.T).argmin(1) for x, c in zip(self.parts(data), self.halves))
        return (i * self.width + j).astype(np.int32)

    def distances(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(-x @ c.T for x, c in zip(self.parts(data), self.halves))


def calibrate(entries: DataFrame, index, sizes: np.ndarray, queries: np.ndarray, k: int, recall: float) -> int:
    """Candidates a query has to meet so that ``queries`` meet the share ``recall`` of their true ``k`` neighbours.

    The queries (a bounded number) are searched against all rows in blocks; a true neighbour needs as many candidates as
    the cells up to its own hold.
    """
    def block(batches):
        for batch in batches:
            if batch.num_rows:
                q, best = _best(queries @ index.value.matrix(batch.column("v")).T, k + 1)
                s = (queries[q] * index.value.matrix(batch.column("v"))[best]).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(s), batch.column("cell").take(pa.array(best))], names=["q", "s", "cell"])

    found = entries.select("v", "cell").mapInArrow(block, "q int, s double, cell int")
    found = found.selectExpr("q", "cell", "row_number() over (partition by q order by s desc, cell) as r").filter(F.col("r") <= k + 1).collect()
    left, right = index.value.distances(queries)
    need, ends = [], {}
    for row in found:
        q = row["q"]
        if q not in ends:
            cells = traverse(left[q], right[q], sizes, int(sizes.sum()))
            ends[q] = dict(zip(cells, np.cumsum(sizes[cells])))
        need.append(ends[q][row["cell"]])
    return int(np.quantile(need, recall, method="higher")) if need else 1


def search(
    rows: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vec: str = "embedding", centroids: int = CENTROIDS, sample: int = SAMPLE,
    recall: float = RECALL, part: int = PART,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: for each query row its ``k`` rows of largest inner product.

    The two halves of a vector are quantised apart, so that the index has ``centroids``^2 cells.  A query walks the cells
    by the summed distance (here the negated inner product) of its halves to the centroids with a heap, until the cells
    hold enough vectors, and these are reranked by the exact inner product in double precision.  Enough is what a bounded
    number of calibration queries need for the share ``recall`` of their true neighbours: few vectors where the data
    cluster, a large part of all where they are spread evenly.  Every row is in the index; only the centroids are fitted
    on ``sample`` rows.  Ties go to the smaller key; a query's own key is no candidate; rows that repeat key and vector
    count once; other columns do not pass.

    Rows without a key, vectors that are null, zero or of another length than most, and those holding a null or
    non-finite component take no part.  Equal vectors are one entry with its ``k`` + 1 smallest keys, which is all that
    a result can need, and equal queries are searched once, so copies cost nothing but their own rows.  A block of cells
    with more than ``part`` entries or queries is dealt to several tasks.  With ``k`` candidates or fewer all are
    returned; an empty table gives no rows.
    """
    session = rows.sparkSession
    size = dimension(rows, vec)
    element = rows.schema[vec].dataType.elementType if isinstance(rows.schema[vec].dataType, ArrayType) else None
    element = element if isinstance(element, (FloatType, DoubleType)) else DoubleType()
    good = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vec).cast(ArrayType(element)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    # -0 and 0 are one value
    good = good.filter(F.col("id").isNotNull() & usable(F.col("v"), size)).withColumn("v", F.transform("v", lambda x: x + F.lit(0).cast(element)))
    good = cut_lineage(good.withColumn("h", F.xxhash64("v")))
    context = session.sparkContext
    kind = good.schema["v"].dataType.simpleString()
    drawn = good.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"]
    if not len(drawn):
        return session.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    index = context.broadcast(Index(np.array(drawn.tolist(), np.float64), centroids))
    blocks, width = index.value.blocks, index.value.width

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.value.cells(index.value.matrix(batch.column("v"))))], names=[*batch.schema.names, "cell"])

    # distinct vectors with their smallest keys: limited before and after the shuffle
    ranked = good.select("h", "v", "id").distinct().selectExpr("h", "v", "id", "row_number() over (partition by h, v order by id) as r").filter(F.col("r") <= k + 1)
    entries = ranked.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = cut_lineage(entries.mapInArrow(assign, f"h bigint, v {kind}, ids array<bigint>, cell int"))
    sizes = np.zeros(blocks * width, np.int64)
    for row in entries.groupBy("cell").count().collect():
        sizes[row["cell"]] = row["count"]

    asked = cut_lineage(good.filter("q").select("id", "h", "v").distinct())
    some = asked.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATION).select("v").toPandas()["v"]
    enough = calibrate(entries, index, sizes, np.array(some.tolist(), np.float64), k, recall) if len(some) else 1
    plan = context.broadcast((sizes, max(enough, k + 1)))

    def probe(batches):
        held, least = plan.value
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = index.value.distances(index.value.matrix(batch.column("v")))
            which, block, cells = [], [], []
            for i in range(batch.num_rows):
                by_block: dict[int, list[int]] = {}
                for c in traverse(left[i], right[i], held, least):
                    by_block.setdefault(c // width, []).append(c)
                which += [i] * len(by_block)
                block += by_block.keys()
                cells += by_block.values()
            at = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("h").take(at), batch.column("v").take(at), pa.array(block, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], names=["h", "v", "block", "cells"])

    probes = cut_lineage(asked.select("h", "v").distinct().mapInArrow(probe, f"h bigint, v {kind}, block int, cells array<int>"))
    asks = {r["block"]: r["count"] for r in probes.groupBy("block").count().collect()}
    held = sizes.reshape(blocks, width).sum(1)
    dealt = F.broadcast(session.createDataFrame(
        [(b, max(1, -(-int(held[b]) // part)), max(1, -(-asks.get(b, 0) // part))) for b in range(blocks)], "block int, parts int, turns int"))
    share = lambda n: F.pmod("h", F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probes.join(dealt, "block").select("h", "v", "cells", "block", share("turns").alias("turn"), every("parts").alias("part"))
    right = entries.withColumn("block", F.floor(F.col("cell") / width).cast("int")).join(dealt, "block")
    right = right.select("v", "ids", "cell", "block", share("parts").alias("part"), every("turns").alias("turn"))

    def rerank(_, asking, holding):
        queries, lists, order = [np.zeros(0, np.int64)], [], np.zeros(0, np.int64)
        scores, entry = [np.zeros(0)], [np.zeros(0, np.int64)]
        if asking.num_rows and holding.num_rows:
            q, e = (index.value.matrix(t.column("v").combine_chunks()) for t in (asking, holding))
            cell, lists = np.asarray(holding.column("cell")), holding.column("ids").to_pylist()
            wanted: dict[int, list[int]] = {}
            for i, cells in enumerate(asking.column("cells").to_pylist()):
                for c in cells:
                    wanted.setdefault(c, []).append(i)
            for c, who in wanted.items():
                at = np.flatnonzero(cell == c)
                for i in range(0, len(who) if len(at) else 0, 512):
                    few = np.array(who[i : i + 512])
                    a, b = _best(q[few] @ e[at].T, k + 1)
                    queries.append(few[a])
                    entry.append(at[b])
                    scores.append((q[few[a]] * e[at[b]]).sum(1))
        queries, entry, scores = map(np.concatenate, (queries, entry, scores))
        order = np.lexsort((-scores, queries))
        queries, entry, scores = queries[order], entry[order], scores[order]
        starts = np.flatnonzero(np.concatenate(([True], queries[1:] != queries[:-1]))) if len(queries) else order
        hs, found, scored = [], [], []
        for a, b in zip(starts, np.append(starts[1:], len(queries))):
            # entries up to the score of the k + 1 st, then the smallest keys
            b = a + np.searchsorted(-scores[a:b], -scores[min(a + k, b - 1)], "right")
            pairs = sorted((-s, x) for s, j in zip(scores[a:b].tolist(), entry[a:b]) for x in lists[j])[: k + 1]
            hs.append(queries[a])
            found.append([x for _, x in pairs])
            scored.append([s for s, _ in pairs])
        chosen = asking.select(["h", "v"]).take(pa.array(hs, pa.int64()))
        return chosen.append_column("ids", pa.array(found, pa.list_(pa.int64()))).append_column("scores", pa.array(scored, pa.list_(pa.float64())))

    met = left.groupBy("block", "part", "turn").cogroup(right.groupBy("block", "part", "turn"))
    near = met.applyInArrow(rerank, f"h bigint, v {kind}, ids array<bigint>, scores array<double>")
    # a query has one list a part of a block, of k + 1 at most
    lists = near.groupBy("h", "v").agg(F.flatten(F.collect_list(F.arrays_zip(F.col("scores").alias("s"), F.col("ids").alias("i")))).alias("all"))
    lists = cut_lineage(lists.select(F.struct("h", "v").alias("hv"), F.slice(F.array_sort("all"), 1, k + 1).alias("best")))
    answers = join_unique(asked.select("id", F.struct("h", "v").alias("hv")), lists, "hv")
    answers = answers.select("id", F.slice(F.filter("best", lambda x: x["i"] != F.col("id")), 1, k).alias("best"))
    return answers.select(F.col("id").alias("query_id"), F.posexplode("best").alias("p", "b")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.i").alias("vec_id"), (-F.col("b.s")).alias("score"))
