"""SimHash near-duplicates: pigeonhole blocks of the fingerprints, an equi-join on blocks, then the Hamming distance."""

from __future__ import annotations

from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from newsgraph.session import cut_lineage

from .common import as_bytes, components, join_unique, map_texts

SHINGLE = 3
SEED = 42
#: Fingerprints link at this many differing bits or fewer.
DISTANCE = 2
#: Blocks of 16 bits; a pair within the distance agrees on two of the four at least.
BLOCKS = 4
#: Blocks with more fingerprints are linked through midpoints and not pair by pair.
MOST_PAIRED = 64
#: Shingles counted at once.
_STEP = 1 << 15


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def bit_counts(data: bytes | None, size: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, int]:
    """How many of the shingles' hashes, repeats included, hold each of 64 bits, and how many shingles there are."""
    words = (data or b"").lower().split()
    if not words:
        return np.zeros(64, np.int64), 0
    heads = [words[i:] for i in range(min(size, len(words)))]
    counts, total = np.zeros(64, np.int64), len(heads[-1])
    shingles, digest = zip(*heads), xxhash.xxh64_intdigest
    for _ in range(0, total, _STEP):
        h = np.fromiter((digest(b" ".join(s), seed) for s in islice(shingles, _STEP)), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return counts, total


def fingerprint(data: bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint; a bit is set if it is in over half of the shingles' hashes, repeats included."""
    counts, total = bit_counts(data, size, seed)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Columns ``keep`` and ``fp`` (the fingerprint as a signed bigint) of each whole text; no words give zero."""

    def make():
        return lambda texts: [pa.array([_signed(fingerprint(x, size, seed)) for x in as_bytes(texts)], pa.int64())]

    return map_texts(docs, make, "fp bigint", keep, text)


def links(values: DataFrame, blocks: int = BLOCKS, most: int = MOST_PAIRED) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` of ``values`` exactly as distance 2 or less does.

    A fingerprint is cut into ``blocks``; two within distance 2 agree on all but two blocks, so each set of that many
    blocks is a join key.  Keys that one fingerprint holds alone are dropped by their counts.  A key of at most ``most``
    fingerprints is joined pair by pair and verified.  In a larger one every fingerprint names itself and all its
    neighbours at one bit outside the key: two are within distance 2 exactly if they name a common one, and at most 65
    fingerprints name it, so a star replaces the pairs.  Either way emits rows in proportion to the fingerprints.
    """
    if not 3 <= blocks <= 32:
        raise ValueError("blocks must be 3 to 32: pairs within distance 2 have to share one")
    at = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (at[b + 1] - at[b])) - 1) << at[b] for b in chosen) for chosen in combinations(range(blocks), blocks - DISTANCE)]
    keys = values.select("fp", F.explode(F.array(*(
        F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)))).alias("k")
    ).select("fp", "k.kind", "k.key")
    shared = cut_lineage(keys.join(keys.groupBy("kind", "key").agg(F.count("*").alias("n")).filter("n > 1"), ["kind", "key"]))
    few, many = shared.filter(F.col("n") <= most).drop("n"), shared.filter(F.col("n") > most)
    paired = few.alias("x").join(few.alias("y"), (F.col("x.kind") == F.col("y.kind")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")))
    paired = paired.filter(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= DISTANCE).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    free = F.element_at(F.array(*(F.array(*(F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1)) for m in masks)), F.col("kind") + 1)
    named = many.select("kind", "key", "fp", F.explode(F.concat(F.array(F.lit(0).cast("bigint")), free)).alias("bit"))
    named = named.groupBy("kind", "key", F.col("fp").bitwiseXOR(F.col("bit")).alias("middle")).agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    starred = named.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a != b")
    return paired.unionByName(starred).distinct()


def _rooted(docs: DataFrame, key: str, text: str, size: int, seed: int) -> DataFrame:
    """One row a row: ``__key``, ``fp``, ``root`` (a fingerprint that names the group) and ``component``."""
    rows = cut_lineage(fingerprints(docs, [key], text, size, seed).select(F.col(key).alias("__key"), "fp"))
    values = cut_lineage(rows.groupBy("fp").agg(F.min("__key").alias("first"), F.count("*").alias("n")))
    roots = components(links(values.select("fp"))).withColumnsRenamed({"node": "fp"})
    joined = values.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = joined.groupBy("root").agg(F.min("first").alias("component"), F.sum("n").alias("rows")).filter("rows > 1")
    named = cut_lineage(joined.select("fp", "root").join(firsts, "root").select("fp", "root", "component"))
    return join_unique(rows, named, "fp").select("__key", "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "__key").alias("component"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``key``, ``fp`` and ``component`` (smallest key of the rows reachable over links, itself included), one row a row.

    Equal texts share a fingerprint and are joined as one, so copies cost nothing but their own rows.  Null and empty
    texts have fingerprint zero and link like any other.  A null key takes the component of its group and never names
    one, so a group of null keys only has a null component.  Rows of one key stay separate rows.  An empty table gives
    none.  Other columns do not pass.
    """
    return _rooted(docs, key, text, size, seed).select(F.col("__key").alias(key), "fp", "component")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one of smallest key, all columns as they are.

    A key names one document: rows that repeat a kept key stay together.  Rows without a key go if their group has a
    keyed document; of a group without one the row of smallest text digest stays.  Null and empty texts are one group.
    An empty table stays empty.  Columns may have any names but those that begin with two underscores.
    """
    found = cut_lineage(_rooted(docs, key, text, SHINGLE, SEED))
    kept = found.filter(F.col("__key") == F.col("component")).select(F.col("__key").alias("__name"), F.lit(True).alias("__kept")).distinct()
    keyed = join_unique(docs.filter(F.col(key).isNotNull()).withColumn("__name", F.col(key)), kept, "__name")
    keyed = keyed.filter("__kept").select(*docs.columns)
    roots = found.filter("__key is null and component is null").select(F.col("fp").alias("__fp"), F.col("root").alias("__root")).distinct()
    names = {c: f"__doc_{c}" for c in docs.columns}
    bare = docs.filter(F.col(key).isNull()).withColumnsRenamed(names)
    bare = fingerprints(bare, list(names.values()), names[text]).withColumnRenamed("fp", "__fp").join(roots, "__fp")
    row = F.struct(*(F.col(new).alias(old) for old, new in names.items()))
    bare = bare.groupBy("__root").agg(F.min_by(row, F.sha2(F.coalesce(F.col(names[text]), F.lit("")), 256)).alias("__row"))
    return keyed.unionByName(bare.select("__row.*"))
