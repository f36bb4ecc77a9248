"""Sinks: digest artifacts, query log, urgent export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsgraph.functions import scoring as S


def write_digests(digests: DataFrame, folder: str) -> None:
    """One JSON artifact per user, date and content type; rewriting replaces just the partitions written."""
    (
        digests.repartition("user_id", "date", "content_type")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("user_id", "date", "content_type")
        .json(folder)
    )


def read_digests(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def append_log(log: DataFrame, folder: str) -> None:
    log.write.mode("append").json(folder)


def urgent_export(articles: DataFrame, as_of: Column, hours: int = 6) -> DataFrame:
    """Urgent items of the last hours: title, url, source, score."""
    when = F.coalesce("published_at", "fetched_at")
    fresh = S.hours_between(when, as_of) <= hours
    return articles.filter(F.col("urgent") & fresh).select(
        "title", F.col("final_url").alias("url"), F.col("source_name").alias("source"), "global_score"
    )
