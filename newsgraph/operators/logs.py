"""Rollups of request and query logs, and the budget report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from newsgraph.functions import cards as CD, maps


def request_rollup(log: DataFrame, limit: int | None = 20) -> DataFrame:
    """Totals per path; the largest paths by bytes, or all paths for ``limit=None``."""
    total = F.col("response_bytes") + F.col("dependency_bytes")
    grouped = log.groupBy(F.coalesce("path", F.lit("unknown")).alias("path")).agg(
        F.count("*").alias("requests"),
        F.sum("response_bytes").alias("response_bytes"),
        F.sum("dependency_bytes").alias("dependency_bytes"),
        F.sum("cache_hits").alias("cache_hits"),
        F.sum("cache_misses").alias("cache_misses"),
        F.sum("cache_sets").alias("cache_sets"),
        F.sum("duration_ms").alias("_ms"),
    )
    rolled = (
        grouped.withColumn("avg_response_bytes", maps.round_half_even(F.col("response_bytes") / F.col("requests"), 2))
        .withColumn("avg_duration_ms", maps.round_half_even(F.col("_ms") / F.col("requests"), 2))
        .drop("_ms")
    )
    return rolled if limit is None else rolled.orderBy(total.desc(), F.desc("requests"), "path").limit(limit)


def dependency_targets(log: DataFrame, limit: int = 20) -> DataFrame:
    one = log.select(F.explode("dependency_targets").alias("t"))
    grouped = one.groupBy(
        F.coalesce("t.service", F.lit("unknown")).alias("service"), F.coalesce("t.target", F.lit("unknown")).alias("target")
    ).agg(F.sum("t.bytes").alias("bytes"))
    return grouped.orderBy(F.desc("bytes"), "service", "target").limit(limit)


def query_rollup(log: DataFrame, limit: int = 30) -> DataFrame:
    """Totals per statement fingerprint.  Callers are the services that issue statements: a short list."""
    grouped = log.groupBy("sql_hash").agg(
        F.min("sql_fingerprint").alias("sql_fingerprint"),
        F.count("*").alias("queries"),
        F.sum("estimated_bytes").alias("total_bytes"),
        F.sum("row_count").alias("total_rows"),
        F.sum("duration_ms").alias("_ms"),
        F.array_join(F.array_sort(F.collect_set("caller")), ",").alias("callers"),
    )
    return (
        grouped.withColumn("avg_bytes", F.rint(F.col("total_bytes") / F.col("queries")).cast("long"))
        .withColumn("avg_duration_ms", maps.round_half_even(F.col("_ms") / F.col("queries"), 2))
        .withColumn("total_human", CD.human_bytes(F.col("total_bytes")))
        .drop("_ms")
        .orderBy(F.desc("total_bytes"), "sql_hash")
        .limit(limit)
    )


def caller_rollup(log: DataFrame, limit: int = 30) -> DataFrame:
    grouped = log.groupBy("caller", "sql_hash").agg(
        F.count("*").alias("n"), F.sum("estimated_bytes").alias("b"), F.sum("row_count").alias("r")
    )
    return (
        grouped.groupBy("caller")
        .agg(
            F.sum("n").alias("queries"), F.sum("b").alias("total_bytes"), F.sum("r").alias("total_rows"),
            F.count("*").alias("statements"),
        )
        .orderBy(F.desc("total_bytes"), "caller")
        .limit(limit)
    )


def size_estimate(df: DataFrame, groups: list[str], order: list[str], size: str, rows: int = 10) -> DataFrame:
    """Bytes of the first ten rows times the row count over ten; exact for short results."""
    counts = df.groupBy(*groups).agg(F.count("*").alias("row_count"))
    first = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col("_rn") <= rows)
    head = first.groupBy(*groups).agg(F.sum(size).alias("_bytes"), F.count("*").alias("_n"))
    return counts.join(head, groups).select(
        *groups, "row_count", (F.col("_bytes") / F.col("_n") * F.col("row_count")).cast("long").alias("estimated_bytes")
    )


def budget_score(actual, budget):
    """Ten for a quarter of the budget down to one for over twice."""
    ratio = actual / budget
    return (
        F.when(budget <= 0, 5)
        .when(ratio <= 0.25, 10)
        .when(ratio <= 0.50, 9)
        .when(ratio <= 0.75, 7)
        .when(ratio <= 1.0, 5)
        .when(ratio <= 1.5, 3)
        .when(ratio <= 2.0, 2)
        .otherwise(1)
    )


def budget_report(rollup: DataFrame, budgets: DataFrame, baseline_gb_per_day: float = 10.0) -> DataFrame:
    """Score per endpoint, and the transfer per day and month against the earlier volume."""
    c = F.col
    rows = rollup.join(budgets, "path")
    daily = c("avg_response_bytes") * c("requests_per_day")
    per = rows.select(
        "path",
        budget_score(c("avg_duration_ms"), c("max_ms")).alias("latency_score"),
        budget_score(c("avg_response_bytes"), c("max_bytes")).alias("size_score"),
        daily.alias("daily_bytes"),
        (daily <= c("max_bytes") * c("requests_per_day")).alias("within_budget"),
    )
    all_rows = F.sum("daily_bytes").over(Window.partitionBy())
    return per.withColumn("monthly_gb", maps.round_half_even(all_rows * 30 / 1024**3, 2)).withColumn(
        "reduction_pct", maps.round_half_even((1 - all_rows / 1024**3 / baseline_gb_per_day) * 100, 1)
    )
