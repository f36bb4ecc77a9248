"""Candidate triage: relevance, pre-score, scrape decision and target lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsgraph.functions import features as FT, maps, scoring as S
from newsgraph.operators.ranking import top_per_group


def with_triage(items: DataFrame) -> DataFrame:
    """Add relevance, pre_score, decision and reason.  Row-local: no shuffle.

    The columns come out of a one-element explode: a later filter on the decision then stays above it
    and the similarity is computed once per row.
    """
    c = F.col
    social = S.social_score(c("hn_points"), c("reddit_upvotes"), c("github_stars"))

    def judge(relevance: Column, pre: Column) -> Column:
        choice = S.scrape_decision(c("always_scrape"), relevance, c("title"), pre, c("authority"))
        return maps.let(
            choice,
            lambda d: F.struct(
                relevance.alias("relevance"), pre.alias("pre_score"), d["decision"].alias("decision"), d["reason"].alias("reason")
            ),
        )

    judged = maps.let(
        FT.relevance(FT.anchor_similarity(c("title"))),
        lambda relevance: maps.let(
            F.round(S.pre_score(c("authority"), relevance, S.keyword_score(c("title")), social), 6),
            lambda pre: judge(relevance, pre),
        ),
    )
    staged = maps.once(items, "_t", judged)
    return staged.select(*items.columns, "_t.relevance", "_t.pre_score", "_t.decision", "_t.reason")


def _order() -> list[Column]:
    return [
        F.coalesce("published_at", "fetched_at").desc(), F.col("pre_score").desc_nulls_last(), F.col("article_id").asc(),
    ]


def scrape_targets(items: DataFrame, done: DataFrame, full: int = 50, watch: int = 15) -> DataFrame:
    """Newest undone items: ``full`` for a full fetch, ``watch`` from the watch band."""
    left = items.join(done.select("article_id"), "article_id", "left_anti")
    band = F.when(F.col("decision").isin("fetch_full", "fetch_full_priority"), "full").when(
        F.col("decision") == "fetch_watch", "watch"
    )
    picked = top_per_group(left.withColumn("band", band).filter("band is not null"), ["band"], _order(), max(full, watch), "pos")
    return picked.filter(F.col("pos") <= F.when(F.col("band") == "full", full).otherwise(watch))


def scrape_targets_by_kind(items: DataFrame, done: DataFrame, per_kind: int = 50) -> DataFrame:
    left = items.join(done.select("article_id"), "article_id", "left_anti")
    wanted = left.filter(F.col("decision").isin("fetch_full", "fetch_full_priority"))
    return top_per_group(wanted, ["source_kind"], _order(), per_kind, "pos")


