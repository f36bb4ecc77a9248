"""Top-k, full ranks, caps and interleaving.

Top-k per group uses ``row_number() <= k``: Spark limits each group before the shuffle, so a group
that holds a third of all rows sends k rows per task.  A full rank of unbounded groups is computed in
bounded ranges (``rank_all``); no task ever sorts one whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgraph.session import cut_lineage


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    name = rank or "_rn"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(
        F.col(name) <= k
    )
    return ranked if rank else ranked.drop(name)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by ``order`` (ascending).  An aggregate, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, "_row.*").select(*df.columns)


def top_rows(df: DataFrame, order: list[Column], k: int, rank: str = "pos") -> DataFrame:
    """First k rows with their position.  ``limit`` after ``orderBy`` keeps k rows per task."""
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def rank_all(df: DataFrame, keys: list[str], order: list[str], rank: str = "pos") -> DataFrame:
    """Exact rank of every row within ``keys`` by ascending ``order``, for groups of any size.

    Rows are dealt by ranges of keys and order, so a large group lies in several tasks and their number follows the
    session's.  A row's rank is its place within its range plus the rows of its group in lower ranges, which only
    groups that cross a border have: fewer rows than there are ranges.
    """
    dealt = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    dealt = cut_lineage(dealt.withColumn("_place", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))))
    counts = dealt.groupBy("_part", *keys).agg(F.max("_place").cast("bigint").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    across = counts.withColumn("_before", F.sum("_n").over(before)).filter("_before is not null")
    across = F.broadcast(across.select(*[F.col(k).alias(f"_o_{k}") for k in ["_part", *keys]], "_before"))
    joined = dealt.alias("s").join(across, [F.col(f"s.{k}").eqNullSafe(F.col(f"_o_{k}")) for k in ["_part", *keys]], "left")
    return joined.select(*[F.col(f"s.{c}") for c in df.columns], (F.col("_place") + F.coalesce("_before", F.lit(0))).alias(rank))


def soft_cap(df: DataFrame, groups: list[str], source: str, pos: str, cap: int, limit: int) -> DataFrame:
    """First ``cap`` rows per source in order, then the overflow in order, ``limit`` rows in all.

    Only the first ``cap`` rows per source and the first 2·limit rows overall can be chosen: when the
    capped rows do not fill the limit there are fewer than ``limit`` of them, so 2·limit leading rows
    hold enough overflow.
    """
    within = Window.partitionBy(*groups, source).orderBy(pos)
    lead = Window.partitionBy(*groups).orderBy(pos)
    # Positions are dense per group, so the leading rows are a filter rather than a sort.
    capped = df.withColumn("_rn", F.row_number().over(within)).filter(F.col("_rn") <= cap).withColumn(
        "_over", F.lit(False)
    )
    leading = df.withColumn("_at", F.row_number().over(lead)).filter(F.col("_at") <= 2 * limit).drop("_at")
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}")) for c in groups + [pos]]
    over = (
        leading.alias("l")
        .join(capped.select(*groups, pos).alias("c"), keys, "left_anti")
        .withColumn("_rn", F.lit(cap + 1))
        .withColumn("_over", F.lit(True))
    )
    final = Window.partitionBy(*groups).orderBy("_over", pos)
    return (
        capped.unionByName(over)
        .withColumn("slot", F.row_number().over(final))
        .filter(F.col("slot") <= limit)
        .drop("_rn", "_over")
    )


def interleave(
    df: DataFrame, groups: list[str], category: str, priority: Column, order: list[Column], pos: str, limit: int
) -> DataFrame:
    """One per category per round in priority order; lists that already fit keep their own order."""
    per_category = Window.partitionBy(*groups, category).orderBy(*order)
    size = df.groupBy(*groups).agg(F.count("*").alias("_size")) if groups else df.agg(F.count("*").alias("_size"))
    rounds = df.withColumn("_round", F.row_number().over(per_category)).filter(F.col("_round") <= limit)
    rounds = rounds.join(size, groups) if groups else rounds.withColumn(
        "_size", F.lit(size.first()["_size"])
    )
    fits = F.col("_size") <= limit
    final = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    final = final.orderBy(
        F.when(fits, F.lit(0)).otherwise(F.col("_round")), F.when(fits, F.lit(0)).otherwise(priority), pos
    )
    return (
        rounds.withColumn("slot", F.row_number().over(final))
        .filter(F.col("slot") <= limit)
        .drop("_round", "_size")
    )


def backfill(
    selected: DataFrame, spare: DataFrame, groups: list[str], key: str, source: str, order: list[Column],
    limit: int, at_least: int = 20, per_source: int = 2,
) -> DataFrame:
    """Fill a short selection from the spare rows: first those whose source stays within ``per_source``
    counting what is already selected, then any.

    At most ``target`` spare rows can be used, so ``target`` per source and ``target`` overall suffice.
    """
    target = min(limit, max(1, at_least))
    have = selected.groupBy(*groups).agg(F.count("*").alias("_have"))
    per = selected.groupBy(*groups, source).agg(F.count("*").alias("_used"))
    open_rows = spare.join(selected.select(*groups, key), groups + [key], "left_anti")
    by_source = Window.partitionBy(*groups, source).orderBy(*order)
    # The first ``target`` of every source contain the first ``target`` overall.
    ranked = open_rows.withColumn("_rn", F.row_number().over(by_source)).filter(F.col("_rn") <= target)
    ranked = ranked.join(per, groups + [source], "left").join(have, groups, "left")
    second = F.coalesce(F.col("_used"), F.lit(0)) + F.col("_rn") > per_source
    final = Window.partitionBy(*groups).orderBy(second, *order)
    return (
        ranked.withColumn("fill", F.row_number().over(final))
        .filter(F.col("fill") <= F.lit(target) - F.coalesce(F.col("_have"), F.lit(0)))
        .drop("_rn", "_used", "_have")
    )


def serendipity(
    ranked: DataFrame, selected: DataFrame, groups: list[str], key: str, share: str, eligible: Column, pos: str,
    at_most: int,
) -> DataFrame:
    """The best eligible rows not selected: max(1, round-half-even(share * selected)) per group."""
    have = selected.groupBy(*groups).agg(F.count("*").alias("_have"))
    quota = F.greatest(F.lit(1), F.bround(F.col(share) * F.coalesce(F.col("_have"), F.lit(0)), 0).cast("int"))
    spare = ranked.filter(eligible & (F.col(share) > 0)).join(selected.select(*groups, key), groups + [key], "left_anti")
    kept = top_per_group(spare, groups, [F.asc(pos)], at_most, "_sr")
    return kept.join(have, groups, "left").filter(F.col("_sr") <= quota).drop("_sr", "_have")


def union_first_wins(lists: list[DataFrame], groups: list[str], key: str, pos: str) -> DataFrame:
    """Concatenate ranked lists; a key keeps its place in the first list that has it."""
    tagged = [df.withColumn("list_no", F.lit(i)) for i, df in enumerate(lists)]
    union = tagged[0]
    for df in tagged[1:]:
        union = union.unionByName(df)
    return first_per_key(union, groups + [key], ["list_no", pos])
