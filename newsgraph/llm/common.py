"""Helpers of the operators: texts through Arrow in bounded slices, data folds, hot-key joins, components."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from newsgraph.session import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bytes that a word may hold, A-Z as a-z: 0-9, a-z and every byte of a character beyond ASCII; all others as spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A key is hot if it holds over a thousandth of the rows, so at most this many keys are.
HOT_SHARE = 1000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def held_out(key: Column, modulus: int, rest: int) -> Column:
    """True for the rows kept out of learning.  A row without a key is not held out."""
    return F.coalesce(remainder(key, modulus) == rest, F.lit(False))


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch whose texts hold about ``most`` bytes together, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def map_texts(
    docs: DataFrame, make: Callable[[], Callable], out: str, keep: list[str], text: str = "text", most: int = 4 << 20, also: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` and the columns ``out`` (DDL) that a kernel derives from each text.

    ``make()`` runs once in a task and returns the kernel: an Arrow array of texts (and the arrays of the columns ``also``)
    to one Arrow array per column of ``out``.  An own column replaces a kept one of the same name.
    """
    own = StructType.fromDDL(out)
    keep = [c for c in keep if c not in own.names]
    also = also or []
    source = docs.select(*keep, F.col(text).cast("string").alias("__text"), *(F.col(c).alias(f"__also_{c}") for c in also))
    schema = StructType([*(source.schema[c] for c in keep), *own])

    def run(batches):
        kernel = make()
        for batch in batches:
            for part in slices(batch, "__text", most):
                made = kernel(part.column("__text"), *(part.column(f"__also_{c}") for c in also))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=schema.names)

    return source.mapInArrow(run, schema)


def join_unique(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join to a side with one row a key, where any key of ``left`` may hold most of its rows.

    Keys over a thousandth of the rows (fewer than 1,000 by that count) meet a broadcast of their rows; the others are
    shuffled.  ``left`` is read several times: give a materialised one.  Rows with a null key stay, unmatched.
    """
    most = left.count() / HOT_SHARE
    hot = left.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > most).select(key).dropna()
    hot = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    rows = left.join(hot, key, "left")
    few = right.join(hot, key, "left_semi")
    return rows.filter("__hot").drop("__hot").join(F.broadcast(few), key, "left").unionByName(
        rows.filter("__hot is null").drop("__hot").join(right, key, "left"))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) for the nodes of undirected ``edges`` (a, b).

    Alternates large and small stars until no edge changes; each step is a minimum per node (summed before the shuffle)
    and a join, and is written to the shared folder.
    """
    links = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        links = cut_lineage(small.select("e.*").filter("a != b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
