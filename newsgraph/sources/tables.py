"""Readers for the parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table with its timestamps as instants in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
    for field in df.schema:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def as_of(spark: SparkSession, folder: str):
    """Reference time of the data: the latest event."""
    return table(spark, folder, "events").agg(F.max("ts").alias("t")).first()["t"]


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` to as many tasks as ``newsgraph.spread`` says; without that setting as they were read.

    A file of one row group is one task, whatever its size, so work per row on a few such files would run on few cores.
    Whoever reads such files sets the number; a table of many files needs no exchange.
    """
    tasks = int(df.sparkSession.conf.get("newsgraph.spread", "0"))
    return df.repartition(tasks, key) if tasks > 1 else df
