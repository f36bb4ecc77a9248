"""Verification backfill of stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsgraph.functions import trust as TR


def backfill_verification(rows: DataFrame, as_of: Column, hours: int, batch: int, force: bool = False) -> DataFrame:
    """Newest ``batch`` rows of the window without a stored state (or all, if forced), verified."""
    c = F.col
    window = rows.filter(c("created_at") >= as_of - F.make_dt_interval(hours=F.lit(hours)))
    if not force:
        window = window.filter(c("stored_state").isNull())
    # Rank on the key columns alone; the long texts join the chosen rows afterwards.
    chosen = window.select("article_id", "created_at").orderBy(F.desc("created_at"), "article_id").limit(batch)
    picked = rows.join(F.broadcast(chosen.select("article_id")), "article_id", "left_semi")
    return picked.withColumn("state", c("verdict.state")).withColumn(
        "label", TR.label_for_state(c("verdict.state"), c("verdict.confidence"))
    )
