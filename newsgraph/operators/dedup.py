"""Admission, deduplication, matching across sources, upserts and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsgraph.constants import COMMUNITY_KINDS
from newsgraph.functions import text as T, urls as U
from newsgraph.operators.ranking import first_per_key

COUNTERS = ["hn_points", "hn_comments", "reddit_upvotes", "github_stars"]


def admit(candidates: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """Candidates that enter the item table, tagged insert or update.

    Story URLs only; sitemap entries need a date; the first wins per (source, external id), then per
    canonical hash; hashes already known are skipped; a known (source, external id) is overwritten.
    """
    ok = candidates.filter(U.is_news_candidate(F.col("url")))
    ok = ok.filter((F.col("source_kind") != "sitemap") | F.col("published_at").isNotNull())
    ok = ok.withColumn("canonical_hash", T.canonical_hash(F.col("title"), F.col("url")))
    once = first_per_key(ok, ["source_id", "external_id"], order)
    unique = first_per_key(once, ["canonical_hash"], order)
    fresh = unique.join(known.select("canonical_hash"), "canonical_hash", "left_anti")
    keys = known.select("source_id", "external_id").distinct().withColumn("_known", F.lit(True))
    return fresh.join(keys, ["source_id", "external_id"], "left").withColumn(
        "action", F.when(F.col("_known"), "update").otherwise("insert")
    ).drop("_known")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Table with the rows of ``rows`` replacing or joining it by key."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*table.columns))


def match_by_url(candidates: DataFrame, items: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Matched item id per candidate: the same URL, else the newest recent item with the same URL key.

    Items are reduced to one per URL and one per key before the join, so a key shared by a third of
    all items meets each candidate once.
    """
    when = F.coalesce("published_at", "fetched_at")
    dated = items.select("item_id", "url", when.alias("_t"), U.url_key(F.col("url")).alias("_key"))
    exact = dated.groupBy("url").agg(F.min("item_id").alias("exact_id"))
    cutoff = as_of - F.make_dt_interval(days=F.lit(days))
    newest = (
        dated.filter((F.col("_t") >= cutoff) & (F.col("_key") != ""))
        .groupBy("_key")
        .agg(F.max_by("item_id", F.struct("_t", -F.col("item_id"))).alias("key_id"))
    )
    return (
        candidates.withColumn("_key", U.url_key(F.col("url")))
        .join(exact, "url", "left")
        .join(newest, "_key", "left")
        .withColumn("matched_id", F.coalesce("exact_id", "key_id"))
        .drop("_key", "exact_id", "key_id")
    )


def fold_counters(items: DataFrame, mentions: DataFrame, key: str) -> DataFrame:
    """Items with each social counter raised to the largest value among community mentions."""
    have = [c for c in COUNTERS if c in mentions.columns]
    best = mentions.groupBy(key).agg(*[F.max(c).alias(f"_m_{c}") for c in have])
    joined = items.join(best, key, "left")
    for name in have:
        old = F.coalesce(F.col(name), F.lit(0))
        joined = joined.withColumn(
            name, F.when(F.coalesce(F.col(f"_m_{name}"), F.lit(0)) > old, F.col(f"_m_{name}")).otherwise(F.col(name))
        )
    return joined.drop(*[f"_m_{c}" for c in have])


def community(candidates: DataFrame) -> DataFrame:
    return candidates.filter(F.col("source_kind").isin(COMMUNITY_KINDS))


def patch(table: DataFrame, changes: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """Preference upsert: only given fields replace, missing rows start from the defaults."""
    fields = list(defaults)
    old = table.select(*keys, *[F.col(f).alias(f"_o_{f}") for f in fields])
    new = changes.select(*keys, *[F.col(f).alias(f"_n_{f}") for f in fields])
    return old.join(new, keys, "full_outer").select(
        *keys, *[F.coalesce(F.col(f"_n_{f}"), F.col(f"_o_{f}"), F.lit(defaults[f])).alias(f) for f in fields]
    )


def latest_snapshot(snapshots: DataFrame, value: str, at: str) -> DataFrame:
    return snapshots.agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def take_labels(articles: DataFrame, labels: DataFrame) -> DataFrame:
    """Replace label and topics of weak, important articles by landed labels."""
    c = F.col
    weak = (c("event_type") == "OTHER") | (
        F.coalesce(F.array_max(F.map_values("topics")), F.lit(0.0)) < 0.35
    )
    worth = (c("global_score") >= 60) | (c("decision") == "fetch_full_priority")
    landed = labels.select("article_id", c("event_type").alias("_event"), c("topics").alias("_topics"))
    joined = articles.join(landed, "article_id", "left").withColumn("reclassified", weak & worth & c("_event").isNotNull())
    return (
        joined.withColumn("event_type", F.when(c("reclassified"), c("_event")).otherwise(c("event_type")))
        .withColumn("topics", F.when(c("reclassified"), F.coalesce("_topics", "topics")).otherwise(c("topics")))
        .drop("_event", "_topics")
    )
