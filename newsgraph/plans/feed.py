"""Feeds: the live feed, the weekly list, the urgent list and per-reader digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, functions as F

from newsgraph import constants as K
from newsgraph.functions import cards as CD, maps, scoring as S, urls as U
from newsgraph.operators import offers as OF, ranking as R
from newsgraph.operators.diversity import mmr
from newsgraph.operators.people import WEIGHTS
from newsgraph.operators.selection import hide_sample
from newsgraph.session import cut_lineage

SAMPLE_FEED = "Local Sample Feed"
MAX_BOOST = 13  # the most the editorial rank can add to a score
POOL = 300
c = F.col


def with_reader(rows: DataFrame, reader: Row) -> DataFrame:
    """One reader's preferences as constants: nothing to join."""
    columns = {}
    for name, value in reader.asDict(recursive=True).items():
        kind = name[: -len("_weights")] if name.endswith("_weights") else None
        if kind in WEIGHTS:
            entries = [
                F.struct(F.lit(k).alias("key"), F.struct(F.lit(float(v["weight"])).alias("weight"), F.lit(bool(v["blocked"])).alias("blocked")).alias("value"))
                for k, v in sorted(value.items())
            ]
            empty = F.expr("cast(map() as map<string,struct<weight:double,blocked:boolean>>)")
            columns[name] = F.map_from_entries(F.array(*entries)) if entries else empty
        else:
            columns[name] = F.lit(value)
    return rows.withColumns(columns)


def fresh_rows(articles: DataFrame, as_of: Column, hours: int, floor: float) -> DataFrame:
    """Fresh story rows over the score floor.  The floor and the time bounds reach the scan."""
    cutoff = as_of - F.make_dt_interval(hours=F.lit(hours))
    rows = articles.filter(
        S.is_fresh(c("source_kind"), c("published_at"), c("fetched_at"), cutoff)
        & (F.coalesce("final_score", "global_score") >= floor)
    )
    return rows.filter(~U.is_evergreen(c("final_url")))


def with_context(rows: DataFrame, clusters: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Cluster counts, editorial rank, social score and age; rows outside the age bounds go.

    ``clusters``: cluster_id, coverage_count, sources_count, independent_count, max_score, official, trust.
    """
    base = F.coalesce("final_score", "global_score")
    editorial = S.editorial_rank(
        F.when(F.coalesce("max_score", F.lit(0.0)) == 0, base).otherwise(c("max_score")),
        F.greatest(F.coalesce("coverage_count", F.lit(1)), F.lit(1)),
        F.greatest(F.coalesce("independent_count", F.lit(1)), F.lit(1)),
        F.coalesce("official", F.lit(False)), c("trust"),
    )
    when = S.event_time(c("source_kind"), c("published_at"), c("fetched_at"))
    staged = (
        rows.join(clusters.withColumn("_clustered", F.lit(True)), "cluster_id", "left")
        .withColumn("base_score", base)
        .withColumn("editorial_rank", F.when(c("_clustered"), editorial).otherwise(base))
        .withColumn("coverage_score", S.log_share(F.coalesce("sources_count", F.lit(1)), 8))
        .withColumn("social", S.social_score(c("hn_points"), c("reddit_upvotes"), c("github_stars")))
        .withColumn("event_time", when)
        .withColumn("age_hours", S.hours_between(c("event_time"), as_of))
        .drop("_clustered")
    )
    return staged.filter(c("event_time").isNotNull() & (c("age_hours") >= 0) & (c("age_hours") <= hours))


def personal(rows: DataFrame, base: str) -> Column:
    return S.personal_score(
        c(base), c("event_type"), c("topics"), c("entities"), c("source_name"), c("authority"), c("coverage_score"),
        c("social"), U.is_official(c("final_url")),
    )


def scored(rows: DataFrame, base: str, half_life: float) -> DataFrame:
    """Personal score, decayed rank and the displayed integer score."""
    return (
        maps.once(rows, "user_score", personal(rows, base))
        .withColumn("rank_score", F.round(S.feed_rank(c("user_score"), c("age_hours"), c("recency_bias"), half_life), 6))
        .withColumn("shown_score", S.clamp(F.rint("user_score"), 0.0, 100.0).cast("int"))
    )


def with_card(rows: DataFrame) -> DataFrame:
    return rows.withColumn("category", CD.category(c("event_type"), c("topics"))).withColumn(
        "shown_source", CD.attribution(c("source_kind"), c("source_name"), c("final_url"))["source"]
    )


CARD = [
    "user_id", "article_id", "title", "final_url", "source_name", "content_type", "min_show_score", "event_time", "age_hours", "base_score", "editorial_rank",
    "user_score", "rank_score", "shown_score", "min_score", "category", "shown_source", "trust_label", "urgent", "serendipity",
]


def settled(rows: DataFrame) -> DataFrame:
    """Scored rows written once: the selection steps read them several times and need few columns.

    The scores' expressions are large; from here on plans start at the written rows.
    """
    return cut_lineage(rows.select(*[n for n in CARD if n in rows.columns]))


def choose(
    rows: DataFrame, vectors: DataFrame, limit: int, cap: int | None, min_score: Column, serendipity_on: str | None,
    fill: bool = True,
) -> DataFrame:
    """MMR, serendipity, source cap and backfill: (user_id, article_id, slot)."""
    g, key = ["user_id"], "article_id"
    keep = ["user_id", key, "rank_score", "shown_source", "serendipity"] + ([serendipity_on] if serendipity_on else [])
    good = rows.filter(c("user_score") >= min_score).select(*keep)
    # a few dozen rows a reader, used twice: kept in memory, computed again if lost
    picked = mmr(good, vectors, g, key, "rank_score", limit).persist()
    order = picked.select("user_id", key, c("pick").alias("pos"))
    if serendipity_on:
        # Ranks beyond MMR's picks; the quota never exceeds the selection itself.
        extra = R.serendipity(
            good.withColumn("_ord", F.struct((-c("rank_score")).alias("a"), c(key).alias("b"))), order, g, key,
            "serendipity", c(serendipity_on) >= 75, "_ord", limit,
        )
        extra = extra.select("user_id", key, "_ord").withColumn(
            "pos", F.row_number().over(R.Window.partitionBy("user_id").orderBy("_ord")) + F.lit(limit)
        )
        order = order.unionByName(extra.select("user_id", key, "pos"))
    named = order.join(good.select("user_id", key, "shown_source"), ["user_id", key])
    if cap is None:
        final = R.Window.partitionBy("user_id").orderBy("pos")
        return named.withColumn("slot", F.row_number().over(final)).filter(c("slot") <= limit).select("user_id", key, "slot")
    # At most ``limit`` rows per reader from here on.
    capped = R.soft_cap(named, g, "shown_source", "pos", cap, limit).select("user_id", key, "slot", "shown_source").persist()
    if not fill:
        return capped.select("user_id", key, "slot")
    low = rows.filter(c("user_score") < min_score).select("user_id", key, "rank_score", "shown_source")
    more = R.backfill(capped, low, g, key, "shown_source", [F.desc("rank_score"), F.asc(key)], limit)
    offset = capped.groupBy("user_id").agg(F.count("*").alias("_n"))
    more = more.join(offset, "user_id", "left").select(
        "user_id", key, (c("fill") + F.coalesce("_n", F.lit(0))).cast("int").alias("slot")
    )
    return capped.select("user_id", key, "slot").unionByName(more)


def _floor(content: str | None) -> float:
    quiet = content is not None and content != "news"
    return max(1, (10 if quiet else 15) - MAX_BOOST)


def live_scores(articles: DataFrame, clusters: DataFrame, reader: Row, as_of: Column, hours: int, floor: float) -> DataFrame:
    """All fresh rows scored once; every tab reads them."""
    rows = with_reader(with_context(fresh_rows(articles, as_of, hours, floor), clusters, as_of, hours), reader)
    return settled(with_card(scored(rows, "editorial_rank", 18.0)))


def tab_of(rows: DataFrame, content: str | None, sample: bool = False) -> DataFrame:
    """Rows of one tab with the tab's score floor and threshold.  ``sample`` keeps the sample feed beside others."""
    quiet = content is not None and content != "news"
    kept = rows.filter(c("base_score") >= _floor(content))
    kept = kept.filter(c("content_type") == content) if content else kept
    kept = kept if sample else hide_sample(kept, "source_name", SAMPLE_FEED)
    return kept.withColumn("min_score", F.least("min_show_score", F.lit(25.0)) if quiet else c("min_show_score"))


def live_candidates(
    articles: DataFrame, clusters: DataFrame, reader: Row, as_of: Column, hours: int = 24, content: str | None = None
) -> DataFrame:
    """Scored rows that the live feed selects from."""
    return tab_of(live_scores(articles, clusters, reader, as_of, hours, _floor(content)), content)


def stream_items(articles: DataFrame, clusters: DataFrame, reader: Row, as_of: Column, hours: int = 24, content: str | None = None) -> DataFrame:
    """New articles of a stream scored as in the live feed, those over the reader's threshold, with their card fields.

    Every step is a map or a join with a table, so a stream of articles stays a stream without state.
    """
    rows = with_reader(with_context(fresh_rows(articles, as_of, hours, _floor(content)), clusters, as_of, hours), reader)
    kept = tab_of(with_card(scored(rows, "editorial_rank", 18.0)), content, sample=True)
    return kept.filter(c("user_score") >= c("min_score"))


def _picked(rows: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    picks = choose(rows, vectors, limit, 4, c("min_score"), "shown_score")
    return rows.join(F.broadcast(picks), ["user_id", "article_id"])


def live_feed(articles, clusters, vectors, reader, as_of, limit: int = 30, hours: int = 24, content: str | None = None) -> DataFrame:
    return _picked(live_candidates(articles, clusters, reader, as_of, hours, content), vectors, limit)


def weekly_candidates(articles, clusters, reader, as_of, base: str = "editorial_rank") -> DataFrame:
    """Top articles of the clusters seen in the last week, the 200 best scored."""
    cutoff = as_of - F.expr("INTERVAL 7 DAYS")
    tops = clusters.filter(c("last_seen") >= cutoff).select(c("top_article_id").alias("article_id"))
    effective = F.coalesce("final_score", "global_score")
    rows = articles.join(tops, "article_id", "left_semi").filter(effective >= 30)
    rows = rows.orderBy(effective.desc(), "article_id").limit(200)
    rows = hide_sample(rows, "source_name", SAMPLE_FEED).filter(~U.is_evergreen(c("final_url")))
    rows = with_reader(with_context(rows, clusters, as_of, 168), reader)
    return settled(with_card(scored(rows, base, 72.0)).withColumn("min_score", c("min_show_score")))


def weekly_top(articles, clusters, vectors, reader, as_of, limit: int = 20) -> DataFrame:
    rows = weekly_candidates(articles, clusters, reader, as_of)
    picks = choose(rows, vectors, limit, 3, c("min_score"), None)
    return rows.join(F.broadcast(picks), ["user_id", "article_id"])


def week_list(articles, clusters, vectors, reader, as_of, limit: int = 50) -> DataFrame:
    """Week list by base score, with serendipity and without caps."""
    rows = weekly_candidates(articles, clusters, reader, as_of, base="base_score")
    picks = choose(rows, vectors, limit, None, c("min_score"), "base_score")
    return rows.join(F.broadcast(picks), ["user_id", "article_id"])


def urgent_list(articles, clusters, reader, as_of, hours: int = 6) -> DataFrame:
    """Fresh urgent rows at or over the reader's urgent threshold, best final score first."""
    rows = fresh_rows(articles.filter("urgent"), as_of, hours, float("-inf"))
    rows = with_reader(with_context(hide_sample(rows, "source_name", SAMPLE_FEED), clusters, as_of, hours), reader)
    rows = maps.once(rows, "user_score", personal(rows, "base_score")).filter(c("user_score") >= c("min_urgent_score"))
    listed = rows.select("user_id", "article_id", "user_score", "base_score", (-c("base_score")).alias("order_score"))
    return R.rank_all(cut_lineage(listed), [], ["order_score", "article_id"], "pos").drop("order_score")


def today(articles, clusters, vectors, reader, as_of) -> DataFrame:
    """Today's digest items: the mixed feed spread over categories, then each tab's own items."""
    priority = maps.lookup({n: i for i, n in enumerate(K.CATEGORY_PRIORITY)}, c("category"), len(K.CATEGORY_PRIORITY))
    keep = ["user_id", "article_id", "category", "content_type", "shown_score", "urgent", "slot"]
    rows = live_scores(articles, clusters, reader, as_of, 24, _floor("github"))
    mixed = _picked(tab_of(rows, None), vectors, 30).select(*keep)
    mixed = mixed.withColumn("pos", F.struct((-c("shown_score")).alias("a"), c("slot").alias("b"))).drop("slot")
    lists = [
        R.interleave(mixed, ["user_id"], "category", priority, [F.desc("shown_score"), F.asc("pos")], "pos", 12)
        .withColumn("pos", c("slot")).drop("slot")
    ]
    for content in ("news", "research", "github"):
        tab = _picked(tab_of(rows, content), vectors, 10).select(*keep)
        lists.append(tab.withColumn("pos", c("slot")).drop("slot"))
    lists = [df.withColumn("pos", c("pos").cast("int")) for df in lists]
    merged = R.union_first_wins(lists, ["user_id"], "article_id", "pos")
    order = R.Window.partitionBy("user_id").orderBy("list_no", "pos")
    return merged.withColumn("place", F.row_number().over(order))


def breaking(items: DataFrame) -> DataFrame:
    """First urgent item in order."""
    return items.filter("urgent").groupBy("user_id").agg(F.min_by("article_id", "place").alias("article_id"))


# --- digests of all readers -------------------------------------------------------------------


def digest_pool(articles, clusters, vectors, as_of, hours: int = 24, limit: int = POOL) -> DataFrame:
    """The bounded pool every reader's digest is drawn from, best base score first, with vectors."""
    rows = fresh_any(articles, as_of, hours).filter((c("final_score") >= 30) | (c("global_score") >= 30))
    rows = rows.join(vectors.select("article_id"), "article_id", "left_semi")
    rows = rows.orderBy(F.coalesce("final_score", "global_score").desc(), "article_id").limit(limit)
    return with_context(rows, clusters, as_of, hours)


def fresh_any(articles: DataFrame, as_of: Column, hours: int) -> DataFrame:
    cutoff = as_of - F.make_dt_interval(hours=F.lit(hours))
    return articles.filter(S.is_fresh(c("source_kind"), c("published_at"), c("fetched_at"), cutoff))


def pool_items(pool: DataFrame) -> list:
    """The pool's rows as scores need them; the pool holds at most POOL rows."""
    # the decay of an item is the same for all readers: its rank is linear in the score
    items = OF.item_rows(pool, "base_score", S.decay_factor(c("event_type"), c("age_hours"), c("content_type")).alias("decay")).collect()
    if len(items) > POOL:
        raise ValueError("pool exceeds its bound")
    return items


def offers(pool: DataFrame, readers: DataFrame) -> DataFrame:
    """Every reader and pool article over the reader's threshold: (user_id, article_id, user_score, rank_score)."""
    return OF.pool_offers(readers, pool_items(pool), pool.schema["article_id"].dataType.simpleString())


def reader_digests(pool: DataFrame, readers: DataFrame, vectors: DataFrame, limit: int = 30) -> DataFrame:
    """Digest ids of every reader: (user_id, article_id, content_type, slot)."""
    key = "article_id"
    # The pool's rows and vectors (at most POOL) go to the tasks once; a reader's digest is chosen where its scores are.
    held = vectors.join(F.broadcast(pool.select(key)), key, "left_semi").select(key, "embedding").limit(POOL).collect()
    chosen = OF.pool_digests(readers, pool_items(pool), {r[0]: list(r[1]) for r in held}, pool.schema[key].dataType.simpleString(), limit)
    kinds = pool.select(key, "content_type")
    return chosen.join(F.broadcast(kinds), key).select("user_id", key, "content_type", "slot")
