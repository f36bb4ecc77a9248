"""Small selection helpers shared by feeds and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsgraph.operators.ranking import top_per_group


def hide_sample(rows: DataFrame, source: str, sample: str) -> DataFrame:
    """Drop the sample feed as soon as any real row exists: an existence check, then a filter."""
    real = rows.filter(F.col(source) != sample).select(F.lit(1)).limit(1)
    return rows.filter(F.col(source) != sample) if real.count() else rows


def tabs_of(rows: DataFrame, groups: list[str], order: list[Column], key: str, limit: int) -> DataFrame:
    """Ordered ids per content-type tab and for all together, at most ``limit`` each."""
    both = rows.withColumn("tab", F.explode(F.array(F.lit("all"), F.col("content_type"))))
    kept = top_per_group(both, groups + ["tab"], order, limit, "_rn")
    ids = F.array_sort(F.collect_list(F.struct("_rn", F.col(key).cast("string").alias("id"))))
    return kept.groupBy(*groups, "tab").agg(F.array_join(F.transform(ids, lambda s: s["id"]), ",").alias("ids"))
