"""Prefix trie of conversations with subtree totals, rolled up in bands of depths.

Every turn of every conversation is one row that carries the key of its prefix.  A node adds its own figures to its
ancestors within a band of fixed height only; the totals of band roots then go up from band to band, deepest first.  A
row so explodes to one band's height at most, and the rounds are the number of bands.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgraph.session import cut_lineage

#: Least height of a band; a trie deeper than its square takes the root of its depth, so neither side grows faster.
BAND = 32
#: Conversations of a block of this many ids share the opening turns of the first id.
BLOCK = 20
#: Openings are of fewer turns than this.
OPENINGS = 4
#: Bytes of ids in one piece of a list of members.
_PIECE = 1 << 16


def positions(turns: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``turns`` with ``name``, the place (from 1) of a row among those of its keys; a key may hold most of all rows.

    Rows are dealt by ranges of keys and order, so that a large key lies in several tasks; each counts its own rows and
    adds what the ranges before it hold of the key, which only keys that cross a border have.
    """
    dealt = turns.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id())
    dealt = cut_lineage(dealt.withColumn("__own", F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order))))
    counts = dealt.groupBy("__part", *keys).agg(F.max("__own").cast("bigint").alias("__n"))
    across = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    # at most one key a border has rows before it: fewer rows than ranges
    across = F.broadcast(across.filter("__before is not null").select("__part", *keys, "__before"))
    return dealt.join(across, ["__part", *keys], "left").withColumn(
        name, (F.col("__own") + F.coalesce("__before", F.lit(0))).cast("bigint")).drop("__part", "__own", "__before")


def rebuilt(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Conversations (``conv``, ``length``) and their turns (``conv``, ``depth`` from 1, ``role``, ``text``) with shared openings.

    Conversation c has the first h turns of conversation c - c % 20, then its own but for its first h, where h is the
    unsigned crc32 of the decimal c modulo 4.
    """
    own = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own = cut_lineage(positions(own, ["conv"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "place").drop("turn"))
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % OPENINGS
    counts = own.groupBy("conv").agg(F.count("*").alias("own")).withColumn("head", head).withColumn("base", F.col("conv") - F.col("conv") % BLOCK)
    lengths = counts.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    heads = cut_lineage(counts.join(lengths, "base", "left").withColumn("opening", F.least("head", F.coalesce("base_own", F.lit(0))))
                        .withColumn("length", F.col("opening") + F.greatest(F.col("own") - F.col("head"), F.lit(0))))
    openings = own.filter((F.col("conv") % BLOCK == 0) & (F.col("place") < OPENINGS)).withColumnRenamed("conv", "base")
    shared = heads.select("conv", "base", "head").join(openings, "base").filter("place <= head").select("conv", F.col("place").alias("depth"), "role", "text")
    # an opening is shorter than h only where the base has fewer turns than that: what such conversations lack is in few rows
    short = heads.filter("opening < head").select("conv", (F.col("head") - F.col("opening")).alias("lack"))
    rest = own.withColumn("head", head).filter("place > head").join(short, "conv", "left")
    rest = rest.select("conv", (F.col("place") - F.coalesce("lack", F.lit(0))).alias("depth"), "role", "text")
    return heads.select("conv", "length"), shared.unionByName(rest)


def prefixes(turns: DataFrame, height: int) -> DataFrame:
    """``turns`` with ``a``, ``b`` (the key of the prefix that the turn ends), ``up_a``, ``up_b`` (its parent's) and ``words``.

    A key is the exclusive or of two 64-bit hashes of each turn with its depth, so a conversation adds up band by band
    and no task needs its turns in one piece.
    """
    rows = turns.select(
        "conv", "depth", F.floor((F.col("depth") - 1) / height).alias("band"), F.xxhash64(F.lit("a"), "depth", "role", "text").alias("ha"),
        F.xxhash64(F.lit("b"), "depth", "text", "role").alias("hb"), F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")).cast("bigint").alias("words"))
    rows = cut_lineage(rows)
    totals = rows.groupBy("conv", "band").agg(F.bit_xor("ha").alias("ta"), F.bit_xor("hb").alias("tb"))
    before = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv", "band", F.bit_xor("ta").over(before).alias("ta"), F.bit_xor("tb").over(before).alias("tb")).filter("band > 0")
    within = Window.partitionBy("conv", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("a", F.bit_xor("ha").over(within)).withColumn("b", F.bit_xor("hb").over(within)).join(totals, ["conv", "band"], "left")
    rows = rows.withColumn("a", F.col("a").bitwiseXOR(F.coalesce("ta", F.lit(0)))).withColumn("b", F.col("b").bitwiseXOR(F.coalesce("tb", F.lit(0))))
    return rows.select("conv", "depth", "band", "words", "a", "b", F.col("a").bitwiseXOR(F.col("ha")).alias("up_a"), F.col("b").bitwiseXOR(F.col("hb")).alias("up_b"))


def _pack(batches):
    """Pieces of the decimal ids of a node, which arrive in order of node and id."""
    key, first, ids, size = None, None, [], 0

    def piece():
        return pa.RecordBatch.from_pydict({"a": [key[0]], "b": [key[1]], "depth": [key[2]], "first": [first], "ids": [",".join(ids)]})

    for batch in batches:
        for a, b, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "depth", "conv"))):
            if (a, b, depth) != key or size > _PIECE:
                if ids:
                    yield piece()
                key, first, ids, size = (a, b, depth), conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1])
    if ids:
        yield piece()


def _digest(batches):
    """Digest of the pieces of each node, which arrive in order; no list is held whole."""
    key, state, out = None, None, []
    for batch in batches:
        for a, b, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "depth", "ids"))):
            if (a, b, depth) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (a, b, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if len(out) > 4096:
            yield _digests(out)
            out = []
    if key is not None:
        out.append((*key, state.hexdigest()))
    if out:
        yield _digests(out)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(("a", "b", "depth", "ends_sha256"), map(list, zip(*rows)))))


def ends(members: DataFrame) -> DataFrame:
    """``a``, ``b``, ``depth`` and ``ends_sha256`` (the ascending ids of ``conv``, comma-joined) of nodes where conversations end."""
    pieces = members.repartitionByRange("a", "b", "depth", "conv").sortWithinPartitions("a", "b", "depth", "conv")
    pieces = pieces.mapInArrow(_pack, "a bigint, b bigint, depth bigint, first bigint, ids string")
    return pieces.repartition("a", "b", "depth").sortWithinPartitions("a", "b", "depth", "first").mapInArrow(
        _digest, "a bigint, b bigint, depth bigint, ends_sha256 string")


NODE = ["a", "b", "depth"]


def band_totals(nodes: DataFrame, chains: DataFrame, height: int) -> DataFrame:
    """Sums of ``leaf`` and ``saved`` over the subtree of each node that has descendants or figures: ``a``, ``b``, ``depth``, ``n_leaves``, ``saved_tokens``.

    ``chains`` has, for every node, ``chain``: the keys of its ancestors within its band, itself last; band roots have also
    ``above``, those of the whole band over them (the trie's root is left to the caller).
    """
    full = cut_lineage(nodes.join(chains, NODE))
    spread = full.select(F.explode("chain").alias("n"), "leaf", "saved").select("n.*", "leaf", "saved")
    inner = cut_lineage(spread.groupBy(*NODE).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")))
    tops = cut_lineage(full.filter("above is not null").select(*NODE, "above").join(inner, NODE).withColumn("band", F.floor((F.col("depth") - 1) / height)))
    deepest = tops.agg(F.max("band")).first()[0]
    if deepest is None:
        return inner.select(*NODE, F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    done, below = [], None
    for band in range(deepest, 0, -1):
        here = tops.filter(F.col("band") == band).drop("band")
        if below is not None:
            here = here.join(below, NODE, "left").withColumn("leaf", F.col("leaf") + F.coalesce("more", F.lit(0))).withColumn(
                "saved", F.col("saved") + F.coalesce("extra", F.lit(0))).drop("more", "extra")
        here = cut_lineage(here)
        done.append(here)
        below = here.groupBy(F.col("above")[0].alias("top")).agg(F.sum("leaf").alias("more"), F.sum("saved").alias("extra")).select("top.*", "more", "extra")
    total = done[0]
    for one in done[1:]:
        total = total.unionByName(one)
    carried = total.select(F.explode("above").alias("n"), "leaf", "saved").select("n.*", "leaf", "saved")
    return inner.unionByName(carried).groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", band: int = BAND) -> DataFrame:
    """One row a node: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Rows without a conversation are left out; a null role or text is empty; null turns come first and rows of one turn
    follow role and text, so repeated rows are turns of their own.  Texts of any length only pass through a hash.  An
    empty table has no node, not even the root.  Extra columns do not pass and may have any names.
    """
    members, turns = rebuilt(conversations, conv, turn, role, text)
    deepest = members.agg(F.max("length"), F.count("*"), F.min("conv")).first()
    depth, n_convs, first = deepest
    schema = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    if not n_convs:
        return conversations.sparkSession.createDataFrame([], schema)
    height = max(band, int(depth ** 0.5))
    rows = cut_lineage(prefixes(turns, height))
    nodes = rows.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.first("words").alias("words"),
                                    F.first("up_a").alias("up_a"), F.first("up_b").alias("up_b"))
    nodes = cut_lineage(nodes)
    children = nodes.groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = cut_lineage(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("bigint")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")))
    # chains are those of the smallest member: one conversation's rows for each node
    own = rows.join(nodes.select(*NODE, F.col("conv_id").alias("conv")), [*NODE, "conv"]).select("conv", "band").distinct()
    key = F.struct("a", "b", "depth")
    within = Window.partitionBy("conv", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    listed = rows.join(own.unionByName(own.select("conv", (F.col("band") - 1).alias("band"))).distinct(), ["conv", "band"], "left_semi")
    listed = listed.select("conv", "band", *NODE, F.collect_list(key).over(within).alias("chain"))
    wanted = nodes.select(*NODE, F.col("conv_id").alias("conv"))
    over = listed.filter(F.col("depth") % height == 0).select("conv", (F.col("band") + 1).alias("band"), F.col("chain").alias("above"))
    chains = listed.join(wanted, [*NODE, "conv"])
    tops = chains.filter((F.col("depth") % height == 1) & (F.col("band") > 0)) if height > 1 else chains.filter("band > 0")
    chains = chains.filter(~((F.col("depth") % height == 1) & (F.col("band") > 0))).select(*NODE, "chain", F.lit(None).cast(over.schema["above"].dataType).alias("above")).unionByName(
        tops.join(over, ["conv", "band"]).select(*NODE, "chain", "above"))
    totals = band_totals(nodes.select(*NODE, "leaf", "saved"), chains, height)
    finished = members.filter("length > 0").withColumnRenamed("length", "depth")
    finished = ends(rows.join(finished, ["conv", "depth"]).select(*NODE, "conv"))
    parents = nodes.filter("n_children > 0").select(
        F.col("a").alias("up_a"), F.col("b").alias("up_b"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    nothing = hashlib.sha256().hexdigest()
    inner = nodes.join(totals, NODE, "left").join(finished, NODE, "left").join(parents, ["up_a", "up_b", "depth"], "left")
    inner = cut_lineage(inner.select(
        "conv_id", "depth", F.when(F.col("depth") == 1, F.lit(first)).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")))
    bare = ends(members.filter("length = 0").select(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("depth"), "conv"))
    root = inner.filter("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    root = root.join(bare, how="left").select(
        F.lit(first).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"),
        F.lit(n_convs).cast("bigint").alias("n_convs"), "n_children", F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves")).cast("bigint").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("bigint").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
    return inner.unionByName(root)
