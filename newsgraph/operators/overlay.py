"""Landed translations laid over items by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def overlay_translations(items: DataFrame, landed: DataFrame) -> DataFrame:
    """``landed`` has (conv_id, block, positions, reply = JSON array).  A missing field keeps the original;
    a group is ready only if all its parts are translated."""
    parts = F.from_json("reply", "array<struct<text:string>>")
    flat = landed.select(
        "conv_id", "block", F.explode(F.arrays_zip(F.col("positions").alias("pos"), parts.alias("part"))).alias("z")
    ).select("conv_id", "block", F.col("z.pos").alias("pos"), F.col("z.part.text").alias("_translated"))
    joined = items.join(flat, ["conv_id", "block", "pos"], "left")
    status = items.select("conv_id", "block", "pos").join(flat, ["conv_id", "block", "pos"], "left").groupBy("conv_id").agg(
        F.bool_and(F.col("_translated").isNotNull()).alias("_ready")
    )
    return (
        joined.join(status, "conv_id")
        .withColumn("shown", F.coalesce("_translated", "text"))
        .withColumn("status", F.when(F.col("_ready"), "ready").otherwise("unavailable"))
        .drop("_translated", "_ready")
    )
