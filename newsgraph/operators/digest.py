"""Digest copy, archive and daily lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

TABS = ["all", "news", "research", "github"]
# Headlines of empty sections.
EMPTY_HEADLINES = {
    "all": "Daily AI Pulse", "news": "No major industry news today",
    "research": "No notable research papers today", "github": "No trending repos today",
}


def section_copy(items: DataFrame, groups: list[str], tab: str, pos: str, headlines: dict = EMPTY_HEADLINES) -> DataFrame:
    """Headline and summary of the first item per tab; fixed text for an empty tab."""
    c = F.col
    first = items.groupBy(*groups, tab).agg(F.min_by(F.struct("title", "summary"), pos).alias("f"))
    tabs = items.select(*groups).distinct().withColumn(tab, F.explode(F.array(*[F.lit(t) for t in TABS])))
    filled = lambda x: F.nullif(F.coalesce(x, F.lit("")), F.lit(""))
    name = F.lit("Daily AI Pulse")
    for key, text in headlines.items():
        name = F.when(c(tab) == key, text).otherwise(name)
    fallback = F.when(
        c("f").isNull(), F.concat(F.lit("No "), c(tab), F.lit(" updates from the last 24 hours."))
    ).otherwise(F.concat(F.lit("Key AI "), c(tab), F.lit(" updates from the last 24 hours.")))
    return tabs.join(first, groups + [tab], "left").select(
        *groups, tab, F.coalesce(filled(c("f.title")), name).alias("headline"),
        F.coalesce(filled(c("f.summary")), fallback).alias("summary"),
    )


def archive(digests: DataFrame, limit: int = 30) -> DataFrame:
    """Latest dates with a stored long form."""
    c = F.col
    rows = digests.filter((c("content_type") == "longform") & (c("longform_html").isNotNull() | c("storage_path").isNotNull()))
    return (
        rows.select(
            c("user_id"), F.to_date("date").alias("day"), F.coalesce(F.nullif("headline", F.lit("")), F.lit("Daily AI Digest")).alias("headline"),
            F.coalesce("executive_summary", F.lit("")).alias("subtitle"),
        )
        .orderBy(F.desc("day"), "user_id")
        .limit(limit)
    )


def daily(digests: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Stored digest per day: artifact fields where present, row fields otherwise."""
    c = F.col
    rows = digests.filter("content_type = 'longform'").select(
        "user_id", F.to_date("date").alias("day"), "headline", "executive_summary", "longform_html", "storage_path"
    )
    a = artifacts.select(
        c("path").alias("storage_path"), c("headline").alias("a_headline"), c("subtitle").alias("a_subtitle"), c("longform_html").alias("a_html")
    )
    joined = rows.join(a, "storage_path", "left").withColumn("html", F.coalesce("a_html", "longform_html"))
    return joined.select(
        "user_id", "day",
        F.when(c("html").isNotNull(), F.coalesce(F.nullif("a_headline", F.lit("")), "headline")).alias("headline"),
        F.when(c("html").isNotNull(), F.coalesce(F.nullif("a_subtitle", F.lit("")), "executive_summary")).alias("subtitle"),
        c("html").isNotNull().alias("available"),
    )
