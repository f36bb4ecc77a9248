"""Exact similarity search over unit vectors, without comparing everything with everything in one place.

Every vector gets the nearest of a bounded set of pivots; the pivot is its cell.  Angles between unit
vectors obey the triangle inequality, so a row within angle t of x lies in a cell j with
angle(x, pivot j) <= angle(x, own pivot) + 2t.  Cells that lie together form groups of a bounded number of
rows, and a row probes just the groups with such a cell, which becomes an equi-join on the group: a row is
copied once a group, not once a cell.  Cells larger than that are cut into chunks, probes too, so one task
compares two bounded blocks however large a cell is, and equal vectors are collapsed first, so copies add
nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsgraph.operators.ranking import top_per_group
from newsgraph.session import cut_lineage

PIVOTS = 64
MOST_PIVOTS = 4_096
CHUNK = 2048
#: Numbers of a large block of vectors (32,768 of 64 dimensions), and how many large blocks a table has at least.
BLOCK_NUMBERS, BLOCKS = 1 << 21, 8
#: Rows compared at once, and columns; candidates held before they are settled.
STRIP, TILE, HELD = 512, 4096, 1 << 20
SLACK = 1e-5


def unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def stack(column: pd.Series) -> np.ndarray:
    return unit(np.array(column.tolist(), dtype=np.float64)) if len(column) else np.zeros((0, 1))


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of an Arrow column of lists."""
    if not len(column):
        return np.zeros((0, 1))
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return unit(flat.astype(np.float64).reshape(len(column), -1))


def choose_pivots(df: DataFrame, vec: str, count: int | None = None) -> np.ndarray:
    """A sample of the vectors themselves, picked by hash: as many as the root of their number (PIVOTS to MOST_PIVOTS).

    A cell then holds about the root of the number too, whatever the number.
    """
    count = count or min(MOST_PIVOTS, max(PIVOTS, int(df.count() ** 0.5)))
    rows = df.select(vec).orderBy(F.xxhash64(vec)).limit(count).collect()
    return unit(np.array([r[0] for r in rows], dtype=np.float64)) if rows else np.zeros((0, 1))


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def _groups(homes: DataFrame, vec: str, pivots: np.ndarray, size: int | None = None) -> np.ndarray:
    """Group of every pivot's cell: cells that lie together, of at most ``size`` rows unless one cell alone has more.

    Without a ``size`` a group is a large block: an eighth of the rows, up to BLOCK_NUMBERS numbers.
    """
    if len(pivots) < 2:
        return np.zeros(len(pivots), dtype=np.int32)

    def home(batches):
        for batch in batches:
            vectors = stack(batch[vec])
            for at in range(0, len(batch), STRIP):
                yield pd.DataFrame({"home": (vectors[at: at + STRIP] @ pivots.T).argmax(axis=1).astype("int32")})

    held = dict(homes.select(vec).mapInPandas(home, "home int").groupBy("home").count().collect())  # at most MOST_PIVOTS rows
    size = size or max(CHUNK, min(BLOCK_NUMBERS // pivots.shape[1], sum(held.values()) // BLOCKS))
    heads = pivots[: int(len(pivots) ** 0.5)]
    near = pivots @ heads.T
    groups, group, rows = np.zeros(len(pivots), dtype=np.int32), 0, 0
    for cell in np.lexsort((-near.max(axis=1), near.argmax(axis=1))):
        more = held.get(int(cell), 0)
        if rows and rows + more > size:
            group, rows = group + 1, 0
        groups[cell], rows = group, rows + more
    return groups


def _with_cells(df: DataFrame, vec: str, pivots: np.ndarray, reach: float | None, k: int, groups: np.ndarray) -> DataFrame:
    """Add ``home`` and ``probes``, groups of cells.  Without a ``reach`` the bound comes from the k-th nearest
    pivot, which is itself a row: the k-th neighbour is at least that close."""
    columns = df.columns
    order = np.argsort(groups, kind="stable")
    names, starts = np.unique(groups[order], return_index=True)

    def assign(batches):
        for batch in batches:
            vectors = stack(batch[vec])
            for at in range(0, len(batch), STRIP):
                angle = _angles(vectors[at: at + STRIP], pivots)
                own = angle.min(axis=1)
                if reach is not None:
                    bound = np.full(len(angle), reach)
                elif pivots.shape[0] > k:
                    # One place further, since a pivot can be the row itself.
                    bound = np.partition(angle, k, axis=1)[:, k]
                else:
                    bound = np.full(len(angle), np.pi)
                open_cells = angle <= (own + 2.0 * bound + SLACK)[:, None]
                open_groups = np.logical_or.reduceat(open_cells[:, order], starts, axis=1)
                out = batch.iloc[at: at + STRIP].copy()
                out["home"] = groups[(vectors[at: at + STRIP] @ pivots.T).argmax(axis=1)]
                out["probes"] = [names[row] for row in open_groups]
                yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", home int, probes array<int>"
    return df.mapInPandas(assign, schema).select(*columns, "home", "probes")


def _fresh(df: DataFrame) -> DataFrame:
    """Same columns under new ids, so that a table can meet itself."""
    return df.select(*[F.col(name).alias(name) for name in df.columns])


def _blocks(homes: DataFrame, probes: DataFrame, hid: str, pid: str, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Copy home rows and probe rows to the (group, home chunk, probe chunk) blocks where they meet."""
    spread = _fresh(probes).select("*", F.explode("probes").alias("cell")).drop("probes", "home")
    resting = homes.withColumnRenamed("home", "cell").drop("probes")
    sizes = (
        resting.groupBy("cell").agg(F.count("*").alias("_h"))
        .join(spread.groupBy("cell").agg(F.count("*").alias("_p")), "cell")
        .select("cell", F.ceil(F.col("_h") / size).cast("int").alias("hn"), F.ceil(F.col("_p") / size).cast("int").alias("pn"))
    )
    sizes = F.broadcast(sizes)  # one row per group of cells, at most MOST_PIVOTS
    chunk = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = resting.join(sizes, "cell").withColumn("hc", chunk(hid, "hn")).withColumn("pc", every("pn"))
    right = spread.join(sizes, "cell").withColumn("pc", chunk(pid, "pn")).withColumn("hc", every("hn"))
    return left.drop("hn", "pn"), right.drop("hn", "pn")


class _Best:
    """The best homes of a strip of probes, found in single precision and settled in double.

    A dot product of unit vectors in single precision is off by less than ``margin`` / 2, so whatever is among the k best
    in double precision is a candidate.
    """

    def __init__(self, probes: np.ndarray, homes: np.ndarray, k: int, floor: float):
        self.probes, self.homes, self.k = probes, homes, k
        self.margin = (probes.shape[1] + 4) * 2.0 ** -22 + 2e-9
        self.floor = floor
        self.top = np.full((len(probes), k), -np.inf, dtype=np.float32)
        self.rows = self.cols = np.zeros(0, dtype=np.int64)
        self.near = np.zeros(0, dtype=np.float32)

    def bar(self) -> np.ndarray:
        return (np.maximum(self.top[:, -1], self.floor) - self.margin).astype(np.float32)

    def add(self, rows: np.ndarray, cols: np.ndarray, near: np.ndarray) -> None:
        if not len(rows):
            return
        size = len(self.top)
        row, value = np.r_[np.repeat(np.arange(size), self.k), rows], np.r_[self.top.ravel(), near]
        order = np.lexsort((-value, row))
        starts = np.searchsorted(row[order], np.arange(size))
        self.top = value[order][starts[:, None] + np.arange(self.k)]
        self.rows, self.cols, self.near = np.r_[self.rows, rows], np.r_[self.cols, cols], np.r_[self.near, near]
        keep = self.near >= self.bar()[self.rows]
        self.rows, self.cols, self.near = self.rows[keep], self.cols[keep], self.near[keep]
        if len(self.rows) > HELD:
            keep = self.settled()[0]
            self.rows, self.cols, self.near = self.rows[keep], self.cols[keep], self.near[keep]

    def settled(self) -> tuple[np.ndarray, np.ndarray]:
        """Which candidates are the k best of their row, in order, and their similarities.  Ties go to the first home."""
        value = np.zeros(len(self.rows))
        for at in range(0, len(value), 1 << 15):
            part = slice(at, at + (1 << 15))
            value[part] = np.einsum("ij,ij->i", self.probes[self.rows[part]], self.homes[self.cols[part]])
        value = np.round(value, 9)
        order = np.lexsort((self.cols, -value, self.rows))
        row = self.rows[order]
        keep = order[np.arange(len(row)) - np.searchsorted(row, row) < self.k]
        return keep, value[keep]


def best_homes(probes: np.ndarray, homes: np.ndarray, k: int, floor: float, pids=None, hids=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and similarities (nine places) of the k most similar homes of every probe, unit vectors both.

    Similarities under ``floor`` are left out, and pairs of one id where ids are given; ties go to the first home.
    """
    rows, cols, values = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    some = np.flatnonzero(np.isfinite(homes).all(axis=1))
    homes = homes[some]
    first, single = min(TILE, max(STRIP, 8 * k)), homes.astype(np.float32)
    edges = [0, *range(first, len(homes), TILE), len(homes)]
    for at in range(0, len(probes) if len(homes) else 0, STRIP):
        strip = probes[at: at + STRIP]
        mine, best = strip.astype(np.float32), _Best(strip, homes, k, floor)
        for start, end in zip(edges, edges[1:]):
            near = mine @ single[start:end].T
            bar = best.bar()
            if start == 0 and end > k + 1:  # a first bar, which every row's own id may be over
                bar = np.maximum(bar, np.partition(near, end - k - 1, axis=1)[:, end - k - 1] - np.float32(best.margin))
            hits = np.flatnonzero(near >= bar[:, None])
            r, c = np.divmod(hits, end - start)
            value = near.ravel()[hits]
            if pids is not None:
                other = pids[at + r] != hids[some[start + c]]
                r, c, value = r[other], c[other], value[other]
            best.add(r, start + c, value)
        keep, value = best.settled()
        over = value >= floor
        rows.append(best.rows[keep][over] + at), cols.append(some[best.cols[keep][over]]), values.append(value[over])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)


def nearest(
    probes: DataFrame, homes: DataFrame, pid: str, hid: str, vec: str, k: int, at_least: float | None = None,
    count: int | None = None, same: bool = False,
) -> DataFrame:
    """Exact k most similar ``homes`` per probe: (pid, hid, similarity, rank).  Ties go to the smaller id.

    ``same``: both sides are one table and a row is not its own neighbour.
    """
    pivots = choose_pivots(homes, vec, count)
    groups = _groups(homes, vec, pivots)
    reach = None if at_least is None else float(np.arccos(np.clip(at_least, -1.0, 1.0)))
    further = k + (1 if same else 0)
    # written once: blocks are counted before rows are copied to them
    probe_rows = cut_lineage(_with_cells(probes.select(pid, vec), vec, pivots, reach, further, groups))
    home_rows = probe_rows.withColumnRenamed(pid, hid) if same else cut_lineage(_with_cells(homes.select(hid, vec), vec, pivots, 0.0, k, groups))
    left, right = _blocks(home_rows, probe_rows, hid, pid, max(CHUNK, BLOCK_NUMBERS // max(1, pivots.shape[1])))
    hid_type, pid_type = homes.schema[hid].dataType.simpleString(), probes.schema[pid].dataType.simpleString()
    floor = -2.0 if at_least is None else at_least

    def compare(homes: pa.Table, probes: pa.Table) -> pa.Table:
        homes = homes.sort_by(hid)
        hids, pids = homes.column(hid), probes.column(pid)
        own = (pids.to_numpy(), hids.to_numpy()) if same else ()
        rows, cols, value = best_homes(_rows(probes.column(vec)), _rows(homes.column(vec)), k, floor, *own) if len(hids) and len(pids) else ([], [], [])
        return pa.table({pid: pids.take(pa.array(rows, pa.int64())), hid: hids.take(pa.array(cols, pa.int64())), "similarity": pa.array(value, pa.float64())})

    block = ["cell", "hc", "pc"]
    schema = f"`{pid}` {pid_type}, `{hid}` {hid_type}, similarity double"
    spark = homes.sparkSession
    # a block costs far more than its bytes: tasks are as many as the session's, several a core at least
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    left, right = left.repartition(tasks, *block), right.repartition(tasks, *block)
    found = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(compare, schema)
    return top_per_group(found, [pid], [F.desc("similarity"), F.asc(hid)], k, "rank")


def collapse(df: DataFrame, key: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors, each under its smallest key with the number of copies, and the key of every row's
    representative."""
    marked = df.withColumn("_v", F.xxhash64(vec))
    # The hash narrows the group; the vector itself keeps different vectors apart.
    reps = marked.groupBy("_v", vec).agg(F.min(key).alias(key), F.count("*").alias("copies"))
    members = marked.select(F.col(key).alias("member"), "_v", vec).join(
        reps.select(F.col(key).alias("rep"), "_v", vec), ["_v", vec]
    )
    return reps.select(key, vec, "copies"), members.select("member", "rep")


def neighbours(df: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    """Exact k nearest neighbours of every row within one table: (key, neighbour, similarity, rank).

    Search runs over distinct vectors; copies of one vector contribute their k + 1 smallest keys.
    """
    reps, members = collapse(df, key, vec)
    reps = cut_lineage(reps)
    near = nearest(
        reps.withColumnRenamed(key, "a"), reps.withColumnRenamed(key, "b"), "a", "b", vec, k, same=True
    ).select("a", "b", "similarity")
    with_self = near.unionByName(reps.select(F.col(key).alias("a"), F.col(key).alias("b"), F.lit(1.0).alias("similarity")))
    first = top_per_group(members, ["rep"], [F.asc("member")], k + 1).select(F.col("member").alias("neighbour"), F.col("rep").alias("b"))
    offers = with_self.join(first, "b").select("a", "neighbour", "similarity")
    # Per representative at most k + 1 vectors with k + 1 keys each: a bounded list, kept best first.
    lists = top_per_group(offers, ["a"], [F.desc("similarity"), F.asc("neighbour")], k + 1)
    lists = lists.groupBy("a").agg(F.collect_list(F.struct("neighbour", "similarity")).alias("_n"))
    joined = members.join(lists, members["rep"] == lists["a"]).select(F.col("member").alias(key), F.explode("_n").alias("n"))
    pairs = joined.select(key, "n.neighbour", "n.similarity").filter(F.col(key) != F.col("neighbour"))
    return top_per_group(pairs, [key], [F.desc("similarity"), F.asc("neighbour")], k, "rank")


def similar_forest(df: DataFrame, key: str, vec: str, at_least: float) -> DataFrame:
    """Edges (a, b) that connect exactly what the graph of pairs with cosine >= at_least connects.

    Each block emits a spanning forest of its pairs, at most one edge per row, instead of the pairs.
    """
    reps, members = collapse(df, key, vec)
    reps = cut_lineage(reps)
    pivots = choose_pivots(reps, vec)
    reach = float(np.arccos(np.clip(at_least, -1.0, 1.0)))
    rows = cut_lineage(_with_cells(reps.select(key, vec), vec, pivots, reach, 1, _groups(reps, vec, pivots, CHUNK)))
    left, right = _blocks(rows, rows, key, key)
    kind = df.schema[key].dataType.simpleString()

    def forest(left_pdf: pd.DataFrame, right_pdf: pd.DataFrame) -> pd.DataFrame:
        if left_pdf.empty or right_pdf.empty:
            return pd.DataFrame({"a": [], "b": []})
        ids = np.concatenate([left_pdf[key].to_numpy(), right_pdf[key].to_numpy()])
        names, place = np.unique(ids, return_inverse=True)
        left_at, right_at = place[: len(left_pdf)], place[len(left_pdf):]
        hits = stack(right_pdf[vec]) @ stack(left_pdf[vec]).T >= at_least - 1e-9
        label = np.arange(len(names))
        edges = []
        for row in np.flatnonzero(hits.any(axis=1)):
            mine = right_at[row]
            linked = left_at[hits[row]]
            groups, first = np.unique(label[linked], return_index=True)
            for group, at in zip(groups, first):
                if group != label[mine]:
                    edges.append((mine, linked[at]))
                    label[label == group] = label[mine]
        pairs = np.array(edges, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": names[pairs[:, 0]], "b": names[pairs[:, 1]]})

    block = ["cell", "hc", "pc"]
    found = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInPandas(forest, f"a {kind}, b {kind}")
    own = members.filter(F.col("member") != F.col("rep")).select(F.col("member").alias("a"), F.col("rep").alias("b"))
    return found.select("a", "b").unionByName(own)


def mean_vectors(df: DataFrame, group: str, vec: str) -> DataFrame:
    """Mean vector per group, combined before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    means = df.groupBy(group).agg(Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>"))).alias("_m"), F.count("*").alias("n"))
    return means.select(group, vector_to_array("_m").alias(vec), "n")


def project(matrix: np.ndarray) -> np.ndarray:
    """Rows on their first two principal components, each scaled to 0..1.

    A component points to where its largest loading is positive.  One row lies at 0, 0, two at 1, 0 and 0, 0.
    """
    if len(matrix) < 3:
        return np.array([[1.0, 0.0], [0.0, 0.0]])[2 - len(matrix) :]
    centred = matrix - matrix.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=1)[:, None], axis=1) < 0, -1.0, 1.0)
    points = centred @ axes.T
    if points.shape[1] < 2:
        points = np.column_stack([points, np.zeros(len(points))])
    low, wide = points.min(axis=0), np.ptp(points, axis=0)
    return (points - low) / np.where(wide == 0, 1.0, wide)


def planes(df: DataFrame, group: str, key: str, vec: str) -> DataFrame:
    """(group, key, x, y): each group projected by itself.  A group is a snapshot whose size its caller bounds."""
    fields = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in (group, key))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        out = pdf[[group, key]].copy()
        out[["x", "y"]] = project(stack(pdf[vec]))
        return out

    return df.select(group, key, vec).groupBy(group).applyInPandas(place, f"{fields}, x double, y double")


def plane(df: DataFrame, key: str, vec: str) -> DataFrame:
    """First two principal components scaled to 0..1, each pointing to where its largest loading is positive.

    One or two rows are placed by hand.  Only the covariance of the dimensions is summed over all rows.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    few = df.select(key).limit(3).count()
    if few < 3:
        first = df.agg(F.min(key)).first()[0]
        return df.select(key, F.when((F.col(key) == first) & F.lit(few == 2), 1.0).otherwise(0.0).alias("x"), F.lit(0.0).alias("y"))
    data = df.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(data).transform(data)
    model = PCA(k=2, inputCol="_c", outputCol="_p").fit(centred)
    points = model.transform(centred).select(key, vector_to_array("_p").alias("_p"))
    loadings = model.pc.toArray()
    signs = [-1.0 if axis[np.abs(axis).argmax()] < 0 else 1.0 for axis in loadings.T]
    points = points.select(key, (F.col("_p")[0] * signs[0]).alias("x"), (F.col("_p")[1] * signs[1]).alias("y"))
    ends = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    fit = lambda v, lo, hi: (F.col(v) - lo) / (hi - lo) if hi > lo else F.lit(0.0)
    return points.select(key, fit("x", ends["x0"], ends["x1"]).alias("x"), fit("y", ends["y0"], ends["y1"]).alias("y"))
