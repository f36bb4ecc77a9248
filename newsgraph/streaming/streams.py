"""Streaming forms.  Every query reads files as they land and keeps its progress, state and output in a work folder.

A job that is started again with the folder of an earlier run goes on where that one ended; a lost executor loses
nothing.  State is bounded: windows by the watermark, values by key by an expiry in event time."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsgraph.functions import scoring as S
from newsgraph.session import shared_folder
from newsgraph.streaming import keyed

LATENESS = "168 hours"


def read_landing(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream over the parquet files of one table in a landing folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # a table is one file or a folder of files; later files land beside or in it
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{name}*.parquet")
    for field in schema:
        if field.dataType.typeName() == "timestamp_ntz":
            stream = stream.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return stream


def work_folder(spark: SparkSession, name: str | None = None) -> str:
    """Folder of one job in the shared folder: give a job that restarts its own ``name``; without one it is new."""
    return f"{shared_folder(spark)}/streams/{name or uuid.uuid4().hex}"


def drain_append(stream: DataFrame, folder: str) -> DataFrame:
    """Run to the end of the available input into parquet files and read them back."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_update(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Run an updating aggregate; every micro-batch writes its changed keys under its batch number (a retry
    replaces them), and reading takes the newest value per key."""
    schema = stream.schema

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    spark = stream.sparkSession
    saved = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    rest = [n for n in schema.fieldNames() if n not in keys]
    newest = saved.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v"))
    return newest.select(*keys, *[F.col(f"v.{n}").alias(n) for n in rest])


def new_items(stream: DataFrame, last_seen: Column) -> DataFrame:
    """Rows that arrived after ``last_seen``; per-cycle volume is set by the reader, progress by the checkpoint."""
    return stream.filter(F.col("ts") > last_seen)


def within_lateness(stream: DataFrame, as_of: Column, hours: int = 168) -> DataFrame:
    """Late rows and rows from the future go; the watermark bounds the state behind them."""
    cutoff = as_of - F.make_dt_interval(hours=F.lit(hours))
    return stream.filter((F.col("ts") >= cutoff) & (F.col("ts") <= as_of)).withWatermark("ts", LATENESS)


def first_sightings(stream: DataFrame, keys: list[str]) -> DataFrame:
    """First row per key within the lateness window."""
    return stream.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(keys)


def running_maxima(stream: DataFrame, key: str, counters: dict[str, Column], days: int = 30) -> DataFrame:
    """Largest value of each counter by key; a key is forgotten ``days`` after its last row."""
    return keyed.running_maxima(stream, key, counters, LATENESS, days)


def alert_once(stream: DataFrame, folder: str, key: str, condition: Column, columns: list[str], days: int = 30) -> DataFrame:
    """Alerts: the first row of a key that meets ``condition``, and no other in ``days`` after it.

    What has been sent is state of the query, so a batch neither reads earlier output nor runs an action.
    """
    return drain_append(keyed.once(stream, key, condition, columns, LATENESS, days), folder)


def bucketed(stream: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", LATENESS).groupBy(window.alias("w")).agg(
        F.count("*").alias("requests"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("bytes")
    )


def newest_values(stream: DataFrame, key: str, value: str, days: int = 7) -> DataFrame:
    """Newest value per key, forgotten ``days`` after it was stored; ``live_values`` drops expired ones when reading."""
    return keyed.newest_values(stream, key, value, LATENESS, days).withColumn("stored_at", F.timestamp_micros("stored_us"))


def live_values(values: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return values.filter(F.col("stored_at") + F.make_dt_interval(days=F.lit(days)) > as_of)


def urgent_batches(stream: DataFrame, folder: str, as_of: Column, score: Column, hours: int = 6) -> DataFrame:
    """Webhook payloads: urgent rows of the window, one JSON folder per micro-batch."""
    spark = stream.sparkSession
    due = stream.filter((score >= 85) & (S.hours_between(F.col("ts"), as_of) <= hours)).select("event_id", "user_id", score.alias("score"))
    schema = due.schema

    def post(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{folder}/posts/batch={number}")

    query = due.writeStream.foreachBatch(post).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).json(f"{folder}/posts/*")
