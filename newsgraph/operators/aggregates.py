"""Grouped statistics of clusters, topics and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgraph import constants as K
from newsgraph.functions import maps, scoring as S, trust as TR
from newsgraph.operators.ranking import top_per_group


def event_type_rarity(articles: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Rarity per event type over the window; one small grouped count, to be broadcast back."""
    cutoff = as_of - F.make_dt_interval(days=F.lit(days))
    counts = articles.filter(F.col("fetched_at") >= cutoff).groupBy("event_type").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return counts.select("event_type", S.rarity(share).alias("rarity"))


def cluster_stats(articles: DataFrame) -> DataFrame:
    """Coverage, distinct sources, span, top article, headline score.

    The distinct count goes through (cluster, source) partial rows, so a huge cluster is combined
    in many tasks first.
    """
    rows = articles.filter(F.col("cluster_id").isNotNull())
    title = [c for c in ("title",) if c in articles.columns]
    best = F.struct(F.col("global_score"), F.col("authority"), (-F.col("article_id")).alias("_tie"))
    per_source = rows.groupBy("cluster_id", "source_name").agg(
        F.count("*").alias("n"),
        F.min("published_at").alias("first"),
        F.max(F.coalesce("published_at", "fetched_at")).alias("last"),
        F.max(F.struct(best.alias("rank"), F.struct("article_id", *title).alias("row"))).alias("top"),
    )
    out = per_source.groupBy("cluster_id").agg(
        F.sum("n").alias("coverage_count"),
        F.count("*").alias("sources_count"),
        F.min("first").alias("first_seen"),
        F.max("last").alias("last_seen"),
        F.max("top").alias("top"),
    )
    return out.select(
        "cluster_id", "coverage_count", "sources_count", "first_seen", "last_seen",
        F.col("top.row.article_id").alias("top_article_id"),
        F.coalesce("top.rank.global_score", F.lit(0.0)).alias("max_score"),
        *[F.col(f"top.row.{c}").alias("headline") for c in title],
    )


def cluster_confirmation(rows: DataFrame) -> DataFrame:
    """Confirmation level per cluster from article flags."""
    flags = TR.confirmation_flags(F.col("text"), F.col("final_url"), F.col("primary_entity"))
    grouped = rows.groupBy("cluster_id").agg(*[F.bool_or(v).alias(f"_{n}") for n, v in flags.items()])
    level = TR.confirmation(F.col("_official"), F.col("_entity"), F.col("_unattributed"))
    return grouped.select("cluster_id", level.alias("confirmation"))


def with_cluster_trust(articles: DataFrame, as_of: Column) -> DataFrame:
    """Five-part trust score and label of every clustered article, without its text.

    What the text says is read once in its own row; no aggregate and no join carries it.
    """
    c = F.col
    rows = articles.filter(c("cluster_id").isNotNull()).withColumn(
        "primary_entity", F.try_element_at(maps.ranked_entries(c("entities")), F.lit(1))["name"]
    )
    flags = TR.confirmation_flags(c("text"), c("final_url"), c("primary_entity"))
    rows = rows.withColumns({
        **{f"_is_{n}": v for n, v in flags.items()}, "_contradictory": TR.is_contradictory(c("text")), "claims": TR.claim_quality(c("text")),
        "_primary": TR.has_primary_document(c("text"), c("final_url")),
    }).drop("text", "title")
    sources = rows.groupBy("cluster_id", "source_name").agg(F.count("*").alias("_n")).groupBy("cluster_id").agg(
        F.count("*").alias("independent")
    )
    grouped = rows.groupBy("cluster_id").agg(
        *[F.bool_or(f"_is_{n}").alias(f"_{n}") for n in flags],
        F.bool_or("_contradictory").alias("contradictory"),
        F.avg("authority").alias("avg_authority"),
        F.min("created_at").alias("first_report"),
    )
    hours = F.greatest(F.lit(0.0), S.hours_between(c("first_report"), as_of))
    facts = (
        grouped.join(sources, "cluster_id")
        .withColumn("confirmation", TR.confirmation(c("_official"), c("_entity"), c("_unattributed")))
        .withColumn("first_hours", hours)
        .drop("_official", "_entity", "_unattributed")
    )
    joined = rows.drop(*(f"_is_{n}" for n in flags), "_contradictory").join(facts, "cluster_id")
    scored = joined.withColumn(
        "trust",
        TR.trust_score(
            TR.corroboration_trust(c("independent"), c("avg_authority")), c("confirmation.score"),
            TR.source_trust(c("authority"), F.lit(False)), c("claims.quality"),
            c("_primary"), c("event_type"), c("first_hours"),
        ),
    )
    label = TR.trust_label(c("trust"), c("confirmation.level"), c("independent"), c("first_hours"), c("contradictory"))
    return scored.withColumn("label", label)


def dominant_topic(articles: DataFrame, floor: float = 0.25) -> DataFrame:
    """Mean weight per topic over the articles that have topics; the largest, or 'mixed' under the floor."""
    rows = articles.filter(F.col("cluster_id").isNotNull())
    # The denominator is the number of articles with topics, not of articles with this topic.
    sums = rows.select("cluster_id", F.explode("topics").alias("topic", "w")).groupBy("cluster_id", "topic").agg(
        F.sum("w").alias("w")
    )
    sizes = rows.groupBy("cluster_id").agg(F.count_if(F.size("topics") > 0).alias("n"))
    means = sums.join(sizes, "cluster_id").select("cluster_id", "topic", (F.col("w") / F.col("n")).alias("mean"))
    best = means.groupBy("cluster_id").agg(
        F.min(F.struct((-F.round("mean", 9)).alias("o"), F.col("topic"))).alias("b"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("topic", "mean")))).alias("topic_weights"),
    )
    # At most one entry per topic: the collected map is bounded by the topic list.
    named = best.select(
        "cluster_id", "topic_weights", F.when(-F.col("b.o") >= floor, F.col("b.topic")).otherwise("mixed").alias("dominant_topic")
    )
    empty = F.expr("cast(map() as map<string,double>)")
    return sizes.select("cluster_id").join(named, "cluster_id", "left").select(
        "cluster_id",
        F.coalesce("dominant_topic", F.lit("mixed")).alias("dominant_topic"),
        F.coalesce("topic_weights", empty).alias("topic_weights"),
    )


def dominant_event_type(rows: DataFrame, group: str, event: str) -> DataFrame:
    """The event type held by more than half of the rows, else MIXED."""
    counts = rows.filter(F.col(event).isNotNull()).groupBy(group, event).agg(F.count("*").alias("n"))
    top = counts.groupBy(group).agg(
        F.sum("n").alias("total"), F.max(F.struct("n", F.col(event).alias("name"))).alias("top")
    )
    return top.select(
        group, F.when(F.col("top.n") / F.col("total") > 0.5, F.col("top.name")).otherwise("MIXED").alias("dominant_event_type")
    )


def cluster_entities(articles: DataFrame, canon: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """Top entities per cluster by largest weight, after canonical naming; one row per entity."""
    rows = articles.filter(F.col("cluster_id").isNotNull()).select("cluster_id", F.explode("entities").alias("name", "w"))
    if canon is not None:
        rows = rows.join(canon.select(F.col("key").alias("_key"), "canonical"), F.lower("name") == F.col("_key"), "left")
        rows = rows.select("cluster_id", F.coalesce("canonical", "name").alias("name"), "w")
    best = rows.groupBy("cluster_id", "name").agg(F.max("w").alias("weight"))
    kept = top_per_group(best, ["cluster_id"], [F.desc("weight"), F.asc("name")], limit, "pos")
    return kept.withColumn("tier", maps.lookup(K.ENTITY_TIERS, F.col("name")))


def with_velocity(stats: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Coverage per hour of the span, and the pulsing flag of the five fastest."""
    c = F.col
    span = F.coalesce(S.hours_between(c("first_seen"), c("last_seen")), F.lit(0.0))
    staged = stats.withColumn("age_hours", span).withColumn(
        "velocity", c("coverage_count") / F.greatest(c("age_hours"), F.lit(0.1))
    )
    keys = (groups or []) + ["cluster_id"]
    fastest = top_per_group(
        staged.filter(c("velocity") >= 1.0).select(*keys, "velocity"), groups or [], [F.desc("velocity"), F.asc("cluster_id")], 5
    ).select(*keys, F.lit(True).alias("pulsing"))
    return staged.join(fastest, keys, "left").withColumn("pulsing", F.coalesce("pulsing", F.lit(False)))


def sparkline(rows: DataFrame, group: str, when: str, as_of: Column, days: int = 7) -> DataFrame:
    """Rows per day over the last days, oldest first, zeros included."""
    back = F.datediff(as_of, F.col(when))
    per_day = [F.count_if(F.coalesce(back == days - 1 - d, F.lit(False))).alias(f"_d{d}") for d in range(days)]
    grouped = rows.groupBy(group).agg(*per_day)
    return grouped.select(group, F.array(*[f"_d{d}" for d in range(days)]).alias("sparkline"))


def topic_trends(articles: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Summed topic weight per day, every topic present, oldest day first."""
    when = F.coalesce("published_at", "fetched_at")
    back = F.datediff(as_of, when)
    rows = (
        articles.filter(when >= as_of - F.make_dt_interval(days=F.lit(days)))
        .withColumn("_back", back)
        .filter((F.col("_back") >= 0) & (F.col("_back") < days))
        .select(F.explode("topics").alias("topic", "w"), "_back")
    )
    grouped = rows.groupBy("topic").agg(
        *[F.coalesce(F.sum(F.when(F.col("_back") == days - 1 - d, F.col("w"))), F.lit(0.0)).alias(f"_d{d}") for d in range(days)]
    )
    names = articles.sparkSession.createDataFrame([(t, l) for t, l in K.TOPIC_LABELS.items()], "topic string, label string")
    daily = [F.coalesce(F.col(f"_d{d}"), F.lit(0.0)) for d in range(days)]
    total = daily[0]
    for part in daily[1:]:
        total = total + part
    return F.broadcast(names).join(grouped, "topic", "left").select(
        "topic", "label", *[maps.round_half_even(v, 2).alias(f"day{d}") for d, v in enumerate(daily)], maps.round_half_even(total, 2).alias("total")
    )


