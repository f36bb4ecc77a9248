"""C1-C37: signals, importance, trust, verification, decay, personal score, triage."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from newsgraph import constants as K
from newsgraph.catalog import sqlbase as B
from newsgraph.catalog.scalars import SQL_EVENT_TIME, sql_anchor_sims, sql_fresh, sql_ws  # noqa: F401
from newsgraph.functions import features as FT, maps, scoring as S, text as T, trust as TR, urls as U
from newsgraph.operators import offers as OF, people
from newsgraph.session import cut_lineage
from newsgraph.sources import standin as D
from newsgraph.sources.tables import as_of, table

QUERIES: dict = {}
ORACLE: dict = {}
c = F.col


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


A = B.with_(B.ARTICLES)
r6 = lambda x: F.round(x, 6)
NOW = "(SELECT max(ts) FROM events)"

# --- shared SQL pieces ------------------------------------------------------------------------

SQL_CORROBORATION = (
    "(CASE WHEN {n} <= 0 THEN 0.0 ELSE greatest(0.0, (least({n} / 8.0, 1.0) + 2.6896 / (2.0 * {n}) - 1.64 * "
    "sqrt((least({n} / 8.0, 1.0) * (1 - least({n} / 8.0, 1.0)) + 2.6896 / (4.0 * {n})) / {n})) / (1 + 2.6896 / {n})) END)"
)


def sql_corr(n: str) -> str:
    return SQL_CORROBORATION.format(n=f"({n})::DOUBLE")


PROMINENCE = f"""prominence AS (SELECT a.article_id, coalesce(max({B.lookup(K.ENTITY_TIERS, 'x.entity', '0.3')} * x.weight), 0.3) AS prominence
  FROM articles a LEFT JOIN entity_rows x USING (article_id) GROUP BY 1)"""
CLUSTER = """members AS (SELECT * FROM articles WHERE cluster_id IS NOT NULL),
cstats AS (SELECT cluster_id, count(*) AS coverage, count(DISTINCT source_name) AS sources, min(published_at) AS first_seen,
  max(coalesce(published_at, fetched_at)) AS last_seen, max(global_score) AS top_score,
  arg_max(article_id, (global_score, authority, -article_id)) AS top_article, min(created_at) AS first_created FROM members GROUP BY 1)"""


@query("c01_entity_prominence", B.with_(B.ARTICLES, B.ENTITY_ROWS, PROMINENCE) + "SELECT article_id, round(prominence, 6) AS prominence FROM prominence")
def c01(spark, sf):
    return D.articles(spark, sf, text=False).select("article_id", r6(S.entity_prominence(c("entities"))).alias("prominence"))


@query("c02_event_impact", A + f"SELECT article_id, {B.lookup(K.EVENT_IMPACT, 'event_type', '0.4')} AS impact FROM articles")
def c02(spark, sf):
    return D.articles(spark, sf, text=False).select("article_id", S.event_impact(c("event_type")).alias("impact"))


@query("c03_corroboration", f"SELECT event_id, round({sql_corr('user_id % 12')}, 6) AS corroboration FROM events")
def c03(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(S.corroboration(c("user_id") % 12)).alias("corroboration"))


SQL_SOCIAL_VELOCITY = B.clamp(
    "0.45 * " + B.log_share("coalesce(hn_points, 0) / greatest({age}, 0.1)", 200)
    + " + 0.30 * " + B.log_share("coalesce(reddit_upvotes, 0) / greatest({age}, 0.1)", 500)
    + " + 0.25 * " + B.log_share("coalesce(github_stars, 0) / greatest({age}, 0.1)", 100)
)


@query(
    "c04_social_velocity",
    A + f"SELECT article_id, round({SQL_SOCIAL_VELOCITY.format(age=B.hours('fetched_at', NOW))}, 6) AS velocity FROM articles",
)
def c04(spark, sf):
    age = S.hours_between(c("fetched_at"), F.lit(as_of(spark, sf)))
    return D.articles(spark, sf, text=False).select(
        "article_id", r6(S.social_velocity(c("hn_points"), c("reddit_upvotes"), c("github_stars"), age)).alias("velocity")
    )


@query(
    "c05_cluster_velocity",
    f"SELECT user_id, round({B.log_share('(count(*) - 1) / greatest(' + B.hours('min(ts)', 'max(ts)') + ', 0.1)', 10)}, 6) AS velocity FROM events GROUP BY user_id",
)
def c05(spark, sf):
    stats = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return stats.select("user_id", r6(S.cluster_velocity(c("n"), S.hours_between(c("a"), c("b")))).alias("velocity"))


@query(
    "c06_novelty",
    """WITH s AS (SELECT event_id, least(1.0, value / 100) * least(1.0, (user_id % 101) / 100.0) AS s FROM events)
SELECT event_id, round(CASE WHEN s >= 0.85 THEN 0.0 ELSE 1 / (1 + exp(10 * (s - 0.7))) END, 6) AS novelty FROM s""",
)
def c06(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", r6(S.novelty(c("value") / 100, (c("user_id") % 101).cast("double"))).alias("novelty")
    )


@query(
    "c07_event_rarity",
    A + f"""SELECT event_type, round(least(1.0, -log2(greatest(count(*) / sum(count(*)) OVER (), 1e-6)) / {-math.log2(1e-6)!r}), 6) AS rarity
FROM articles WHERE fetched_at >= {NOW} - INTERVAL 90 DAY GROUP BY event_type""",
)
def c07(spark, sf):
    from newsgraph.operators.aggregates import event_type_rarity

    return event_type_rarity(D.articles(spark, sf, text=False), F.lit(as_of(spark, sf))).select("event_type", r6(c("rarity")).alias("rarity"))


@query("c08_funding_score", f"SELECT event_id, round({B.log_share('value * 1000000', 5e9)}, 6) AS score FROM events")
def c08(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(S.funding(c("value") * 1000000)).alias("score"))


SQL_RIGOR = (
    "CASE WHEN source_kind = 'arxiv' THEN 0.9 WHEN contains(lower(substr(text, 1, 5000)), 'arxiv:') OR contains(lower(substr(text, 1, 5000)), 'doi.org/') THEN 0.7 WHEN "
    + " OR ".join(f"contains(lower(substr(text, 1, 5000)), '{p}')" for p in ("we propose", "experiments", "dataset", "ablation"))
    + " THEN 0.55 ELSE 0.35 END"
)


@query("c09_research_rigor", A + f"SELECT article_id, {SQL_RIGOR} AS rigor FROM articles")
def c09(spark, sf):
    return D.articles(spark, sf).select("article_id", S.research_rigor(c("source_kind"), c("text")).alias("rigor"))


@query(
    "c10_source_diversity",
    B.with_(B.ARTICLES, CLUSTER) + "SELECT cluster_id, round(CASE WHEN coverage <= 1 THEN 0.5 ELSE least(1.0, sources / coverage) END, 6) AS diversity FROM cstats",
)
def c10(spark, sf):
    from newsgraph.operators.aggregates import cluster_stats

    stats = cluster_stats(D.articles(spark, sf, text=False))
    return stats.select("cluster_id", r6(S.source_diversity(c("sources_count"), c("coverage_count"))).alias("diversity"))


# Signals of every article, with its cluster's counts; funding and similarity come from the row itself.
SIGNALS = f"""rare AS (SELECT event_type, least(1.0, -log2(greatest(count(*) / sum(count(*)) OVER (), 1e-6)) / {-math.log2(1e-6)!r}) AS rarity
  FROM articles WHERE fetched_at >= {NOW} - INTERVAL 90 DAY GROUP BY event_type),
joined AS (SELECT a.*, p.prominence, r.rarity, coalesce(s.coverage, 1) AS coverage, coalesce(s.sources, 1) AS sources,
  coalesce(s.top_score, 0.0) AS top_score, greatest(0.1, {B.hours('coalesce(a.published_at, a.fetched_at)', NOW)}) AS age,
  greatest(0.1, coalesce({B.hours('s.first_seen', NOW)}, 1.0)) AS cluster_age, (a.article_id % 100) / 100.0 AS sim,
  CASE WHEN a.article_id % 7 = 0 THEN a.article_id * 1000000 END AS usd, (a.article_id % 10) / 10.0 AS quality
  FROM articles a JOIN prominence p USING (article_id) LEFT JOIN rare r USING (event_type) LEFT JOIN cstats s USING (cluster_id)),
sig AS (SELECT *, {SQL_SOCIAL_VELOCITY.format(age='age')} AS s_social, {sql_corr('sources')} AS s_corr,
  {B.log_share('(coverage - 1) / cluster_age', 10)} AS s_velocity,
  (CASE WHEN sim * least(1.0, top_score / 100) >= 0.85 THEN 0.0 ELSE 1 / (1 + exp(10 * (sim * least(1.0, top_score / 100) - 0.7))) END) AS s_novelty,
  {B.log_share('usd', 5e9)} AS s_funding, {SQL_RIGOR} AS s_rigor,
  CASE WHEN coverage <= 1 THEN 0.5 ELSE least(1.0, sources / coverage) END AS s_diversity,
  {B.official('final_url')} AS official FROM joined),
base AS (SELECT *, {B.lookup(K.BASE_IMPORTANCE, 'event_type', '12.0')} + 10 * prominence + 6 * authority + 10 * s_corr + 12 * s_social + 6 * s_velocity
  + 8 * s_novelty + 6 * rarity + 10 * s_funding + 8 * s_rigor + 4 * s_diversity
  + CASE content_type WHEN 'research' THEN 4 * s_rigor + 4 * s_novelty WHEN 'github' THEN 4 * s_social + 4 * s_novelty ELSE 0 END
  + CASE WHEN official THEN 8 ELSE 0 END AS b FROM sig),
lifted AS (SELECT *, CASE WHEN event_type = 'MODEL_RELEASE' AND official THEN
    greatest(90.0, b + 10 + CASE WHEN prominence >= 0.7 THEN 4 ELSE 0 END + CASE WHEN authority >= 0.9 THEN 2 ELSE 0 END)
  WHEN event_type IN {B.lst(K.CONFIRMED_EVENT_TYPES)} AND sources >= 3 THEN b + 5 ELSE b END + CASE WHEN usd >= 1000000000 THEN 4 ELSE 0 END AS l FROM base),
scored AS (SELECT *, least(100.0, round_even(l, 2)) AS s FROM lifted),
importance AS (SELECT article_id, CASE WHEN quality <= 0.30 THEN round_even(s * (0.70 + 0.30 * (quality / 0.30)), 2) ELSE s END AS importance FROM scored)"""


def signal_rows(spark, sf):
    from newsgraph.operators.aggregates import cluster_stats, event_type_rarity

    now = F.lit(as_of(spark, sf))
    rows = D.articles(spark, sf)
    stats = cluster_stats(D.articles(spark, sf, text=False)).select(
        "cluster_id", "coverage_count", "sources_count", "max_score", "first_seen"
    )
    rare = event_type_rarity(D.articles(spark, sf, text=False), now)
    i = c("article_id")
    return (
        rows.join(stats, "cluster_id", "left")
        .join(F.broadcast(rare), "event_type", "left")
        .withColumn("coverage", F.coalesce(c("coverage_count"), F.lit(1)))
        .withColumn("independent", F.coalesce(c("sources_count"), F.lit(1)))
        .withColumn("age", F.greatest(F.lit(0.1), S.hours_between(F.coalesce("published_at", "fetched_at"), now)))
        .withColumn("cluster_age", F.greatest(F.lit(0.1), F.coalesce(S.hours_between(c("first_seen"), now), F.lit(1.0))))
        .withColumn("sim", F.pmod(i, F.lit(100)) / 100.0)
        .withColumn("usd", F.when(F.pmod(i, F.lit(7)) == 0, i * 1000000))
        .withColumn("quality", F.pmod(i, F.lit(10)) / 10.0)
    )


def signals_of() -> dict:
    return {
        "entity_prominence": S.entity_prominence(c("entities")),
        "authority": S.clamp(c("authority")),
        "corroboration": S.corroboration(c("independent")),
        "social_velocity": S.social_velocity(c("hn_points"), c("reddit_upvotes"), c("github_stars"), c("age")),
        "cluster_velocity": S.cluster_velocity(c("coverage"), c("cluster_age")),
        "novelty": S.novelty(c("sim"), F.coalesce(c("max_score"), F.lit(0.0))),
        "event_rarity": F.coalesce(c("rarity"), F.lit(0.5)),
        "funding": S.funding(c("usd")),
        "research_rigor": S.research_rigor(c("source_kind"), c("text")),
        "source_diversity": S.source_diversity(c("independent"), c("coverage")),
    }


@query("c11_importance", B.with_(B.ARTICLES, B.ENTITY_ROWS, PROMINENCE, CLUSTER, SIGNALS) + "SELECT article_id, round(importance, 2) AS importance FROM importance")
def c11(spark, sf):
    rows = signal_rows(spark, sf)
    signals = signals_of()
    for name, column in signals.items():
        rows = rows.withColumn(f"s_{name}", column)
    score = S.importance(
        c("event_type"), c("content_type"), {n: c(f"s_{n}") for n in signals}, U.is_official(c("final_url")),
        c("independent"), c("usd"), c("quality"),
    )
    return rows.select("article_id", F.round(score, 2).alias("importance"))


SQL_EDITORIAL = (
    "greatest(0.0, least(100.0, round_even({top} + least({cov} / 5.0, 1.0) * 5 + least({ind} / 4.0, 1.0) * 5 + CASE WHEN {off} THEN 3 ELSE 0 END "
    "- greatest(0.0, (40 - coalesce(nullif({trust}, 0), 40)) * 0.1), 2)))"
)


@query(
    "c12_editorial_rank",
    B.with_(B.ARTICLES, CLUSTER)
    + f"SELECT cluster_id, {SQL_EDITORIAL.format(top='top_score', cov='coverage', ind='sources', off='cluster_id % 3 = 0', trust='((cluster_id * 7) % 90)')} AS rank FROM cstats",
)
def c12(spark, sf):
    from newsgraph.operators.aggregates import cluster_stats

    i = c("cluster_id")
    rank = S.editorial_rank(
        c("max_score"), c("coverage_count"), c("sources_count"), F.pmod(i, F.lit(3)) == 0, F.pmod(i * 7, F.lit(90)).cast("double")
    )
    return cluster_stats(D.articles(spark, sf, text=False)).select("cluster_id", rank.alias("rank"))


@query(
    "c13_corroboration_trust",
    B.with_(B.ARTICLES, CLUSTER)
    + f"SELECT cluster_id, round(least(1.0, ln(1 + sources) / {math.log(11)!r}) * (0.5 + 0.5 * least(1.0, avg(authority))), 6) AS trust FROM members JOIN cstats USING (cluster_id) GROUP BY cluster_id, sources",
)
def c13(spark, sf):
    grouped = D.articles(spark, sf, text=False).filter(c("cluster_id").isNotNull()).groupBy("cluster_id").agg(
        F.countDistinct("source_name").alias("n"), F.avg("authority").alias("a")
    )
    return grouped.select("cluster_id", r6(TR.corroboration_trust(c("n"), c("a"))).alias("trust"))


PRIMARY = "primary_entity AS (SELECT article_id, entity FROM entity_rows QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY weight DESC, entity) = 1)"
_PRESS = " OR ".join(f"contains(lower(text), {B.q(p)})" for p in K.PRESS_PHRASES)
CONFIRM = f"""flags AS (SELECT cluster_id, bool_or({B.official('final_url', K.CONFIRMING_DOMAINS)} OR {_PRESS}) AS official,
  bool_or(coalesce(regexp_matches(lower(text), regexp_escape(lower(e.entity)) || '\\s+(?:said|confirmed|announced|stated)'), false)) AS entity,
  bool_or(regexp_matches(lower(text), {B.q(K.UNATTRIBUTED)})) AS unattributed
  FROM members LEFT JOIN primary_entity e USING (article_id) GROUP BY 1),
confirm AS (SELECT cluster_id, CASE WHEN official THEN 'official' WHEN entity THEN 'attributed' WHEN unattributed THEN 'unattributed' ELSE 'rumor' END AS level,
  CASE WHEN official THEN 1.0 WHEN entity THEN 0.75 WHEN unattributed THEN 0.25 ELSE 0.05 END AS confirm_score FROM flags)"""


@query("c14_official_confirmation", B.with_(B.ARTICLES, B.ENTITY_ROWS, CLUSTER, PRIMARY, CONFIRM) + "SELECT cluster_id, level, confirm_score FROM confirm")
def c14(spark, sf):
    from newsgraph.operators.aggregates import cluster_confirmation

    rows = D.articles(spark, sf).filter(c("cluster_id").isNotNull())
    primary = F.try_element_at(maps.ranked_entries(c("entities")), F.lit(1))["name"]
    return cluster_confirmation(rows.withColumn("primary_entity", primary)).select(
        "cluster_id", "confirmation.level", c("confirmation.score").alias("confirm_score")
    )


@query(
    "c15_source_trust",
    A + "SELECT article_id, round(CASE WHEN article_id % 2 = 0 THEN least(1.0, authority * 1.15) ELSE authority END, 6) AS trust FROM articles",
)
def c15(spark, sf):
    primary = F.pmod(c("article_id"), F.lit(2)) == 0
    return D.articles(spark, sf, text=False).select("article_id", r6(TR.source_trust(c("authority"), primary)).alias("trust"))


CLAIMS = f"""sent AS (SELECT article_id, lower(substr(text, 1, 5000)) AS sample, list_filter(regexp_split_to_array(lower(substr(text, 1, 5000)), '[.!?]+'), lambda s: length(trim(s, ' ' || chr(10))) > 10) AS ss FROM articles),
shares AS (SELECT article_id, len(list_filter(ss, lambda s: {B.has_any('s', K.HEDGES)})) / greatest(len(ss), 1) AS hedging,
  least(1.0, len(list_filter(ss, lambda s: {B.has_any('s', K.ATTRIBUTIONS)})) / greatest(len(ss), 1)) AS attribution,
  least(1.0, {B.n_has('sample', K.SPECIFICS)} / 3.0) AS specificity FROM sent),
claims AS (SELECT *, {B.clamp('0.40 * (1 - hedging) + 0.35 * attribution + 0.25 * specificity')} AS quality FROM shares)"""


@query(
    "c16_claim_quality",
    B.with_(B.ARTICLES, CLAIMS) + "SELECT article_id, round(quality, 6) AS quality, round(hedging, 6) AS hedging, round(attribution, 6) AS attribution, round(specificity, 6) AS specificity FROM claims",
)
def c16(spark, sf):
    return D.articles(spark, sf).select("article_id", TR.claim_quality(c("text")).alias("q")).select(
        "article_id", *[r6(c(f"q.{n}")).alias(n) for n in ("quality", "hedging", "attribution", "specificity")]
    )


SQL_PRIMARY_DOC = B.has_any("(substr(text, 1, 5000) || ' ' || final_url)", K.PRIMARY_DOCS)


@query("c17_primary_document", A + f"SELECT article_id, {SQL_PRIMARY_DOC} AS has_document FROM articles")
def c17(spark, sf):
    return D.articles(spark, sf).select("article_id", TR.has_primary_document(c("text"), c("final_url")).alias("has_document"))


TRUST = f"""contra AS (SELECT cluster_id, bool_or(regexp_matches(lower(substr(text, 1, 2000)), {B.q(K.CONTRADICTIONS)})) AS contradictory,
  avg(authority) AS avg_authority, greatest(0.0, {B.hours('min(created_at)', NOW)}) AS first_hours FROM members GROUP BY 1),
parts AS (SELECT m.article_id, m.event_type, s.sources, k.level, k.confirm_score, x.contradictory, x.first_hours, {SQL_PRIMARY_DOC} AS doc,
  least(1.0, ln(1 + s.sources) / {math.log(11)!r}) * (0.5 + 0.5 * least(1.0, x.avg_authority)) AS t_corr, m.authority AS t_source, q.quality AS t_quality
  FROM members m JOIN cstats s USING (cluster_id) JOIN confirm k USING (cluster_id) JOIN contra x USING (cluster_id) JOIN claims q USING (article_id)),
raw_trust AS (SELECT *, round_even(least(100.0, 100 * (0.30 * t_corr + 0.25 * confirm_score + 0.20 * t_source + 0.15 * t_quality + 0.10 * CASE WHEN doc THEN 1 ELSE 0 END)), 2) AS t0 FROM parts),
floored AS (SELECT *, CASE WHEN event_type = 'RESEARCH_PAPER' AND doc THEN greatest(t0, 65.0) WHEN event_type = 'OPEN_SOURCE_RELEASE' AND doc THEN greatest(t0, 70.0) ELSE t0 END AS t1 FROM raw_trust),
trusted AS (SELECT *, CASE WHEN first_hours < 2 THEN round_even(t1 * 0.90, 2) ELSE t1 END AS trust FROM floored)"""


@query(
    "c18_trust_score",
    B.with_(B.ARTICLES, B.ENTITY_ROWS, CLUSTER, PRIMARY, CONFIRM, CLAIMS, TRUST)
    + """SELECT article_id, trust, CASE WHEN contradictory THEN 'disputed' WHEN level = 'official' THEN 'official' WHEN trust >= 75 AND sources >= 3 THEN 'confirmed'
 WHEN trust >= 55 AND sources >= 2 THEN 'likely' WHEN first_hours < 6 AND first_hours <> 0 THEN 'developing'
 WHEN sources >= 2 AND trust >= 40 AND level <> 'rumor' THEN 'likely' WHEN trust < 40 THEN 'unverified' ELSE 'developing' END AS label FROM trusted""",
)
def c18(spark, sf):
    from newsgraph.operators.aggregates import with_cluster_trust

    return with_cluster_trust(D.articles(spark, sf), F.lit(as_of(spark, sf))).select(
        "article_id", c("trust").alias("trust"), c("label")
    )


_H = B.host("final_url")
_SEG = f"list_filter(string_split({B.path('final_url')}, '/'), lambda s: s <> '')"
SQL_MODE = (
    f"CASE WHEN {_H} IN {B.lst(K.PREPRINT_HOSTS)} THEN 'research_preprint' WHEN {_H} IN {B.lst(K.PUBLISHED_HOSTS)} THEN 'research_published' "
    f"WHEN CASE WHEN {_H} IN ('github.com', 'www.github.com') THEN len({_SEG}) >= 2 AND {_SEG}[1] NOT IN ('topics', 'orgs', 'explore', 'sponsors') "
    f"WHEN {_H} = 'huggingface.co' THEN len({_SEG}) >= 2 AND {_SEG}[1] NOT IN ('docs', 'blog', 'spaces') ELSE {_H} IN {B.lst(K.ARTIFACT_HOSTS)} END THEN 'artifact' "
    f"WHEN {B.official('final_url')} THEN 'official_statement' WHEN source_kind IN {B.lst(K.COMMUNITY_KINDS)} OR {_H} IN {B.lst(K.COMMUNITY_HOSTS)} THEN 'community_post' ELSE 'reported_news' END"
)


@query("c19_verification_mode", A + f"SELECT article_id, {SQL_MODE} AS mode FROM articles")
def c19(spark, sf):
    return D.articles(spark, sf, text=False).select("article_id", TR.verification_mode(c("final_url"), c("source_kind")).alias("mode"))


@query(
    "c20_freshness_state",
    B.with_(B.ARTICLES, CLUSTER)
    + f"SELECT article_id, CASE WHEN h < 6 THEN 'fresh' WHEN h < 24 THEN 'maturing' ELSE 'stable' END AS freshness FROM (SELECT article_id, greatest(0.0, {B.hours('least(created_at, coalesce(first_created, created_at))', NOW)}) AS h FROM articles LEFT JOIN cstats USING (cluster_id))",
)
def c20(spark, sf):
    rows = D.articles(spark, sf, text=False)
    first = rows.filter(c("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.min("created_at").alias("first_created"))
    age = F.greatest(F.lit(0.0), S.hours_between(F.least("created_at", "first_created"), F.lit(as_of(spark, sf))))
    return rows.join(first, "cluster_id", "left").select("article_id", TR.freshness_state(age).alias("freshness"))


SQL_UPDATE = (
    f"CASE WHEN {B.has_any('lower(substr(text, 1, 400))', K.RETRACTIONS)} THEN 'retracted' "
    f"WHEN {B.has_any('lower(substr(text, 1, 400))', K.CORRECTIONS)} THEN 'corrected' ELSE 'active' END"
)


@query("c21_update_status", A + f"SELECT article_id, {SQL_UPDATE} AS status FROM articles")
def c21(spark, sf):
    return D.articles(spark, sf).select("article_id", TR.update_status(c("text")).alias("status"))


_S5 = "lower(substr(text, 1, 5000))"
VERIFY = f"""vin AS (SELECT *, {SQL_MODE} AS mode, {sql_corr('article_id % 6')} AS corr, article_id % 6 AS ind, {B.official('final_url')} AS off, {_H} AS h,
  {B.path('final_url')} AS p, {B.has_any(_S5, K.ANNOUNCEMENTS)} AS ann, {B.has_any(_S5, K.ANONYMOUS_SOURCES)} AS anon, {B.has_any(_S5, K.DIRECT_EVIDENCE)} AS direct,
  {B.has_any(_S5, K.DISPUTES)} AS disp, {B.has_any(_S5, K.VERIFIED_SPECIFICS)} AS spec, {B.has_any(_S5, K.RESEARCH_ARTIFACTS)} AS rart,
  {B.has_any(_S5, K.RESEARCH_WORDS)} AS rword, {SQL_UPDATE} AS upd FROM articles),
conf AS (SELECT *, CASE mode
  WHEN 'artifact' THEN 100 * (0.30 * (CASE WHEN off THEN 1.0 ELSE greatest(0.68, authority * 0.9 + 0.15) END) + 0.35
    + 0.20 * (CASE WHEN contains(p, '/releases') OR h IN ('pypi.org', 'npmjs.com', 'crates.io') THEN 0.85 WHEN h = 'huggingface.co' THEN 0.75 ELSE 0.68 END)
    + 0.10 * (CASE WHEN direct OR ann THEN 0.9 ELSE 0.75 END) + 0.05 * corr)
  WHEN 'official_statement' THEN 100 * (0.35 * (CASE WHEN off THEN 1.0 ELSE authority END) + 0.30 * (CASE WHEN ann THEN 0.92 ELSE 0.76 END)
    + 0.20 * (CASE WHEN ann THEN 0.88 ELSE 0.72 END) + 0.10 * corr + 0.05)
  WHEN 'research_preprint' THEN least(79.0, 100 * (0.20 * 0.68 + 0.25 + 0.15 * (CASE WHEN rart THEN 0.75 ELSE 0.45 END) + 0.15 * (CASE WHEN rword THEN 0.78 ELSE 0.62 END) + 0.10 * corr + 0.15))
  WHEN 'research_published' THEN 100 * (0.20 * 0.78 + 0.20 + 0.15 * (CASE WHEN rart THEN 0.75 ELSE 0.45 END) + 0.15 * (CASE WHEN rword THEN 0.78 ELSE 0.62 END) + 0.15 * corr + 0.15)
  WHEN 'reported_news' THEN 100 * (0.25 * (CASE WHEN anon THEN 0.35 ELSE 0.8 END) + 0.25 * (CASE WHEN anon AND NOT direct THEN 0.35 WHEN direct THEN 0.8 ELSE 0.55 END)
    + 0.25 * corr + 0.10 * authority + 0.10 * (CASE WHEN spec THEN 0.78 ELSE 0.62 END) + 0.05 * (CASE WHEN disp THEN 0 ELSE 1 END))
  ELSE least(69.0, 100 * (0.20 * authority + 0.35 * (CASE WHEN h IN {B.lst(K.COMMUNITY_HOSTS)} THEN 0.15 ELSE 0.45 END) + 0.20 * corr * 0.6
    + 0.10 * (CASE WHEN source_kind IN {B.lst(K.COMMUNITY_KINDS)} THEN 0.25 ELSE 0.4 END) + 0.15 * (CASE WHEN anon THEN 0.75 ELSE 1 END))) END AS confidence FROM vin),
states AS (SELECT *, CASE WHEN upd <> 'active' THEN 'corrected_or_retracted' WHEN disp THEN 'disputed'
  WHEN mode = 'artifact' THEN CASE WHEN confidence >= 60 THEN 'verified_artifact' ELSE 'community_signal' END
  WHEN mode = 'official_statement' THEN 'official_statement'
  WHEN mode = 'research_preprint' THEN CASE WHEN confidence >= 60 THEN 'verified_artifact' ELSE 'single_source_report' END
  WHEN mode = 'research_published' THEN CASE WHEN confidence >= 65 THEN 'verified_artifact' ELSE 'single_source_report' END
  WHEN mode = 'reported_news' THEN CASE WHEN ind >= 2 AND confidence >= 65 THEN 'corroborated_report' ELSE 'single_source_report' END
  ELSE 'community_signal' END AS state,
  round_even(CASE upd WHEN 'retracted' THEN least(confidence, 30.0) WHEN 'corrected' THEN least(confidence, 40.0) ELSE CASE WHEN disp THEN least(confidence, 35.0) ELSE confidence END END, 2) AS final_conf FROM conf),
labelled AS (SELECT *, CASE state WHEN 'verified_artifact' THEN CASE WHEN final_conf >= 75 THEN 'confirmed' ELSE 'likely' END
  WHEN 'single_source_report' THEN CASE WHEN final_conf >= 70 THEN 'likely' ELSE 'unverified' END WHEN 'official_statement' THEN 'official'
  WHEN 'corroborated_report' THEN 'confirmed' WHEN 'community_signal' THEN 'unverified' ELSE 'disputed' END AS label FROM states)"""


def verified(spark, sf):
    """Articles with mode, signal parts, confidence and state."""
    ind = F.pmod(c("article_id"), F.lit(6)).cast("int")
    return (
        D.articles(spark, sf)
        .withColumn("independent", ind)
        .withColumn("mode", TR.verification_mode(c("final_url"), c("source_kind")))
        .withColumn(
            "parts",
            TR.verification_signals(c("mode"), c("final_url"), c("text"), c("source_kind"), c("authority"), c("independent")),
        )
        .withColumn("confidence", TR.verification_confidence(c("mode"), c("parts")))
        .withColumn("verdict", TR.verification_state(c("mode"), c("confidence"), c("independent"), c("text")))
    )


@query("c22_verification_confidence", B.with_(B.ARTICLES, VERIFY) + "SELECT article_id, mode, round(confidence, 6) AS confidence FROM conf")
def c22(spark, sf):
    return verified(spark, sf).select("article_id", "mode", r6(c("confidence")).alias("confidence"))


@query("c23_verification_state", B.with_(B.ARTICLES, VERIFY) + "SELECT article_id, state, final_conf AS confidence, upd AS update_status FROM states")
def c23(spark, sf):
    return verified(spark, sf).select("article_id", "verdict.state", "verdict.confidence", "verdict.update_status")


_SENTENCES = f"greatest(1, len(list_filter(regexp_split_to_array({_S5}, '[.!?]+'), lambda s: regexp_replace(s, '\\s+', '', 'g') <> '')))"


@query(
    "c24_trust_components",
    B.with_(B.ARTICLES, VERIFY)
    + f"""SELECT article_id, label, CASE WHEN state = 'official_statement' THEN 'official' WHEN state IN ('verified_artifact', 'corroborated_report') THEN 'attributed' ELSE 'rumor' END AS level,
 round_even(100 * corr * CASE WHEN mode = 'community_post' THEN 0.6 ELSE 1 END, 1) AS corroboration,
 CASE WHEN mode IN ('artifact', 'research_preprint', 'research_published', 'official_statement') THEN 100.0 ELSE 0.0 END AS primary_document,
 round_even(least(1.0, {B.n_has(_S5, K.ANONYMOUS_SOURCES)} / {_SENTENCES}), 3) AS hedging_ratio,
 round_even(least(1.0, {B.n_has(_S5, K.DIRECT_EVIDENCE)} / {_SENTENCES}), 3) AS attribution_ratio,
 round_even(least(1.0, {B.n_has(_S5, K.VERIFIED_SPECIFICS)} / 3.0), 3) AS specificity FROM labelled""",
)
def c24(spark, sf):
    rows = verified(spark, sf)
    comp = TR.trust_components(c("mode"), c("verdict.state"), c("parts"), c("text"))
    label = TR.label_for_state(c("verdict.state"), c("verdict.confidence"))
    return rows.select("article_id", label.alias("label"), comp.alias("t")).select(
        "article_id", "label", c("t.confirmation_level").alias("level"), "t.corroboration", "t.primary_document",
        "t.hedging_ratio", "t.attribution_ratio", c("t.specificity_score").alias("specificity"),
    )


_REPLY = (
    "CASE event_id % 5 WHEN 0 THEN '{\"impact\": ' || (event_id % 12) || ', \"breadth\": ' || (user_id % 11) || ', \"novelty\": 7}' "
    "WHEN 1 THEN 'Sure: {\"impact\": ' || (event_id % 100) || ', \"breadth\": 40, \"novelty\": ' || (user_id % 90) || '} done' "
    "WHEN 2 THEN 'no answer' WHEN 3 THEN '{\"impact\": 5}' ELSE '{\"impact\": \"6\", \"breadth\": 3, \"novelty\": 2}' END"
)
_VERDICT = f"""replies AS (SELECT event_id, {_REPLY} AS reply FROM events),
objects AS (SELECT event_id, regexp_extract(reply, '\\{{[^}}]+\\}}') AS j FROM replies WHERE regexp_matches(reply, '\\{{[^}}]+\\}}')),
fields AS (SELECT event_id, CAST(j->>'impact' AS INTEGER) AS i, CAST(j->>'breadth' AS INTEGER) AS b, CAST(j->>'novelty' AS INTEGER) AS n FROM objects
  WHERE j->>'impact' IS NOT NULL AND j->>'breadth' IS NOT NULL AND j->>'novelty' IS NOT NULL),
scaled AS (SELECT event_id, CASE WHEN i > 10 OR b > 10 OR n > 10 THEN round_even(i / 10.0, 0) ELSE i END AS i,
  CASE WHEN i > 10 OR b > 10 OR n > 10 THEN round_even(b / 10.0, 0) ELSE b END AS b, CASE WHEN i > 10 OR b > 10 OR n > 10 THEN round_even(n / 10.0, 0) ELSE n END AS n FROM fields),
verdicts AS (SELECT event_id, CAST(greatest(1, least(10, i)) AS INTEGER) AS impact, CAST(greatest(1, least(10, b)) AS INTEGER) AS breadth, CAST(greatest(1, least(10, n)) AS INTEGER) AS novelty FROM scaled)"""


def replies(spark, sf):
    e, u = c("event_id"), c("user_id")
    s = lambda x: x.cast("string")
    text = (
        F.when(e % 5 == 0, F.concat(F.lit('{"impact": '), s(e % 12), F.lit(', "breadth": '), s(u % 11), F.lit(', "novelty": 7}')))
        .when(e % 5 == 1, F.concat(F.lit('Sure: {"impact": '), s(e % 100), F.lit(', "breadth": 40, "novelty": '), s(u % 90), F.lit("} done")))
        .when(e % 5 == 2, "no answer")
        .when(e % 5 == 3, '{"impact": 5}')
        .otherwise('{"impact": "6", "breadth": 3, "novelty": 2}')
    )
    return table(spark, sf, "events").withColumn("reply", text)


@query("c25_verdict_parsing", B.with_(_VERDICT) + "SELECT event_id, impact, breadth, novelty FROM verdicts")
def c25(spark, sf):
    from newsgraph.functions.verdicts import parse_significance

    return replies(spark, sf).select("event_id", parse_significance(c("reply")).alias("v")).filter(c("v").isNotNull()).select("event_id", "v.*")


@query("c26_significance", B.with_(_VERDICT) + "SELECT event_id, round_even((0.5 * impact + 0.25 * breadth + 0.25 * novelty - 1) * 100 / 9, 2) AS score FROM verdicts")
def c26(spark, sf):
    from newsgraph.functions.verdicts import parse_significance

    rows = replies(spark, sf).select("event_id", parse_significance(c("reply")).alias("v")).filter(c("v").isNotNull())
    return rows.select("event_id", S.significance(c("v.impact"), c("v.breadth"), c("v.novelty")).alias("score"))


SQL_FINAL = """CASE WHEN verdict IS NULL THEN rule WHEN upd <> 'active' THEN round_even(least(rule, 0.5 * rule + 0.5 * verdict), 2)
 WHEN 0.55 * rule + 0.45 * verdict >= rule THEN round_even(0.55 * rule + 0.45 * verdict, 2) ELSE round_even(rule - least(20.0,
  (CASE WHEN label IN ('official', 'confirmed', 'likely') THEN 0.5 ELSE 1 END) * CASE WHEN level = 'official' THEN least(5.0, d) ELSE d END), 2) END"""
FINAL = f"""pre_final AS (SELECT *, global_score AS rule, CASE WHEN article_id % 5 <> 0 THEN trust_score END AS verdict,
  CASE WHEN state = 'official_statement' THEN 'official' ELSE 'x' END AS level FROM labelled),
drops AS (SELECT *, (rule - (0.55 * rule + 0.45 * verdict)) * CASE WHEN state IN ('verified_artifact', 'official_statement', 'corroborated_report') THEN 0.5
  WHEN state = 'single_source_report' AND final_conf >= 70 THEN 0.75 ELSE 1 END AS d FROM pre_final),
finals AS (SELECT *, {SQL_FINAL} AS blended FROM drops)"""


def finals(spark, sf):
    rows = verified(spark, sf).withColumn("label", TR.label_for_state(c("verdict.state"), c("verdict.confidence")))
    level = F.when(c("verdict.state") == "official_statement", "official").otherwise("x")
    verdict = F.when(F.pmod(c("article_id"), F.lit(5)) != 0, c("trust_score"))
    return rows.withColumn(
        "blended",
        S.final_score(
            c("global_score"), verdict, level, c("label"), c("verdict.state"), c("verdict.confidence"), c("verdict.update_status")
        ),
    )


@query("c27_final_score", B.with_(B.ARTICLES, VERIFY, FINAL) + "SELECT article_id, blended AS final_score FROM finals")
def c27(spark, sf):
    return finals(spark, sf).select("article_id", c("blended").alias("final_score"))


@query(
    "c28_decayed_rank",
    A + f"SELECT article_id, round_even(global_score * pow(2.0, -{B.hours('created_at', NOW)} / CASE WHEN content_type = 'github' THEN 48.0 ELSE {B.lookup(K.HALF_LIFE_HOURS, 'event_type', '18.0')} END), 2) AS rank FROM articles",
)
def c28(spark, sf):
    age = S.hours_between(c("created_at"), F.lit(as_of(spark, sf)))
    return D.articles(spark, sf, text=False).select(
        "article_id", S.decayed_rank(c("global_score"), c("event_type"), age, c("content_type")).alias("rank")
    )


@query("c29_feed_decay", f"SELECT event_id, round(value * pow(2.0, -{B.hours('ts', NOW)} / (18 / greatest((user_id % 20) / 10.0, 0.01))), 6) AS rank FROM events")
def c29(spark, sf):
    age = S.hours_between(c("ts"), F.lit(as_of(spark, sf)))
    return table(spark, sf, "events").select("event_id", r6(S.feed_rank(c("value"), age, (c("user_id") % 20) / 10.0, 18.0)).alias("rank"))


SQL_URGENT = """(urgent_score >= 85 AND age <= 6 AND CASE WHEN state IN ('disputed', 'corrected_or_retracted') THEN false
 WHEN state IN ('verified_artifact', 'official_statement', 'corroborated_report', 'single_source_report') THEN final_conf >= 70 ELSE false END)"""


@query(
    "c30_urgent",
    B.with_(B.ARTICLES, VERIFY)
    + f"SELECT article_id, {SQL_URGENT} AS urgent, (urgent_score >= 85 AND age <= 6 AND label IN ('official', 'confirmed', 'likely') AND (ind >= 2 OR off)) AS urgent_by_label "
    f"FROM (SELECT *, 80 + global_score / 5 AS urgent_score, {B.hours('created_at', NOW)} / 60 AS age FROM labelled)",
)
def c30(spark, sf):
    rows = verified(spark, sf).withColumn("label", TR.label_for_state(c("verdict.state"), c("verdict.confidence")))
    age = S.hours_between(c("created_at"), F.lit(as_of(spark, sf))) / 60
    score = 80 + c("global_score") / 5
    official, none = U.is_official(c("final_url")), F.lit(None).cast("string")
    conf = c("verdict.confidence")
    return rows.select(
        "article_id",
        S.is_urgent(score, age, c("independent"), official, c("label"), c("verdict.state"), conf).alias("urgent"),
        S.is_urgent(score, age, c("independent"), official, c("label"), none, conf).alias("urgent_by_label"),
    )


def _topic_of(topic: str) -> str:
    return f"coalesce(max(weight) FILTER (topic = '{topic}'), 0.0)"


@query(
    "c31_domain_vector",
    B.with_(B.ARTICLES, B.TOPIC_ROWS)
    + f"""SELECT a.article_id, CASE WHEN event_type IN ('RESEARCH_PAPER', 'BENCHMARK_RESULT') THEN 1.0 ELSE {_topic_of('research_methods')} END AS research,
 CASE WHEN event_type IN ('STARTUP_FUNDING', 'M_AND_A') THEN 1.0 ELSE {_topic_of('startups_funding')} END AS startups,
 CASE WHEN event_type = 'CHIP_HARDWARE' THEN 1.0 ELSE {_topic_of('hardware_chips')} END AS hardware,
 CASE WHEN event_type = 'OPEN_SOURCE_RELEASE' THEN 1.0 ELSE {_topic_of('open_source')} END AS open_source,
 CASE WHEN event_type = 'POLICY_REGULATION' THEN 1.0 ELSE {_topic_of('safety_policy')} END AS policy, {_topic_of('enterprise_apps')} AS tools
 FROM articles a LEFT JOIN topic_rows t USING (article_id) GROUP BY a.article_id, event_type""",
)
def c31(spark, sf):
    return D.articles(spark, sf, text=False).select(
        "article_id", *[v.alias(n) for n, v in S.domain_vector(c("event_type"), c("topics")).items()]
    )


# Personal score of every (reader, article) pair where the reader follows the article's source.
READERS = f"""readers AS (SELECT c_custkey AS user_id, (8 + c_custkey % 5) / 10.0 AS p1, (8 + c_custkey % 4) / 10.0 AS p2, (9 + c_custkey % 3) / 10.0 AS p3,
  (7 + c_custkey % 6) / 10.0 AS p4, (7 + c_custkey % 7) / 10.0 AS p5, (6 + c_custkey % 8) / 10.0 AS p6, c_custkey % 2 = 0 AS p_official,
  (6 + c_custkey % 9) / 10.0 AS credibility, (5 + c_custkey % 10) / 10.0 AS hype, (8 + c_custkey % 5) / 10.0 AS recency,
  30.0 + (c_custkey % 5) * 5.0 AS min_show, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE 0.15 END AS serendipity,
  {B.pick(D.NAMES, 'c_custkey')} AS w_entity, (6 + c_custkey % 10) / 10.0 AS w_entity_w, c_custkey % 29 = 0 AS w_entity_b,
  {B.pick(K.TOPICS, 'c_custkey')} AS w_topic, (7 + c_custkey % 8) / 10.0 AS w_topic_w, c_custkey % 31 = 0 AS w_topic_b,
  'src' || (c_custkey % 20) AS w_source, (7 + c_custkey % 7) / 10.0 AS w_source_w, c_custkey % 37 = 0 AS w_source_b FROM customer)"""
DOMAIN = f"""domain AS (SELECT a.article_id, CASE WHEN event_type IN ('RESEARCH_PAPER', 'BENCHMARK_RESULT') THEN 1.0 ELSE {_topic_of('research_methods')} END AS d1,
 CASE WHEN event_type IN ('STARTUP_FUNDING', 'M_AND_A') THEN 1.0 ELSE {_topic_of('startups_funding')} END AS d2,
 CASE WHEN event_type = 'CHIP_HARDWARE' THEN 1.0 ELSE {_topic_of('hardware_chips')} END AS d3,
 CASE WHEN event_type = 'OPEN_SOURCE_RELEASE' THEN 1.0 ELSE {_topic_of('open_source')} END AS d4,
 CASE WHEN event_type = 'POLICY_REGULATION' THEN 1.0 ELSE {_topic_of('safety_policy')} END AS d5, {_topic_of('enterprise_apps')} AS d6
 FROM articles a LEFT JOIN topic_rows t USING (article_id) GROUP BY a.article_id, event_type)"""
SQL_SOCIAL = "greatest(" + ", ".join((B.log_share("hn_points", 500), B.log_share("reddit_upvotes", 5000), B.log_share("github_stars", 5000))) + ")"


def sql_personal(base: str, coverage: str) -> str:
    """Expects pairs p of readers and articles joined with domain, and topic/entity matches te, tt."""
    return (
        "CASE WHEN (w_source_b AND w_source = source_name) OR (w_entity_b AND me IS NOT NULL) OR (w_topic_b AND mt >= 0.35) THEN 0.0 ELSE least(100.0, round_even("
        f"{base} * {B.clamp('pow(p1, d1) * pow(p2, d2) * pow(p3, d3) * pow(p4, d4) * pow(p5, d5) * pow(p6, d6)', '0.5', '1.8')}"
        f" * (CASE WHEN me IS NULL THEN 1.0 ELSE pow({B.clamp('w_entity_w', '0.6', '1.6')}, me) END)"
        f" * (CASE WHEN mt IS NULL THEN 1.0 ELSE pow({B.clamp('w_topic_w', '0.6', '1.6')}, mt) END)"
        f" * ((CASE WHEN w_source = source_name THEN {B.clamp('w_source_w', '0.7', '1.3')} ELSE 1.0 END) * (CASE WHEN p_official THEN CASE WHEN off THEN 1.05 ELSE 0.98 END ELSE 1.0 END))"
        f" * {B.clamp(f'1 + 0.1 * (credibility - 1) * (authority + {coverage} - 1)', '0.85', '1.15')}"
        f" * {B.clamp('1 + 0.1 * (hype - 1) * (social - authority)', '0.85', '1.15')}, 2)) END"
    )


_FOLLOWED = f"""pairs AS (SELECT r.*, a.*, d.* EXCLUDE (article_id), {SQL_SOCIAL} AS social, {B.official('final_url')} AS off, coalesce(final_score, global_score) AS base_score,
  (SELECT max(weight) FROM entity_rows x WHERE x.article_id = a.article_id AND x.entity = r.w_entity) AS me,
  (SELECT max(weight) FROM topic_rows x WHERE x.article_id = a.article_id AND x.topic = r.w_topic) AS mt
  FROM readers r JOIN articles a ON a.source_name = r.w_source JOIN domain d USING (article_id) WHERE {sql_fresh(NOW + ' - INTERVAL 168 HOUR')})"""


@query(
    "c32_personal_score",
    B.with_(B.ARTICLES, B.TOPIC_ROWS, B.ENTITY_ROWS, READERS, DOMAIN, _FOLLOWED)
    + f"SELECT user_id, article_id, {sql_personal('base_score', B.log_share('1', 8))} AS score FROM pairs",
)
def c32(spark, sf):
    readers = people.with_weights(D.readers(spark, sf), D.reader_weights(spark, sf))
    followed = D.reader_weights(spark, sf)["source"].select("user_id", c("key").alias("source_name"))
    # A reader is scored against the last week of the followed source only.
    cutoff = F.lit(as_of(spark, sf)) - F.expr("INTERVAL 168 HOURS")
    rows = (
        D.articles(spark, sf, text=False)
        .filter(S.is_fresh(c("source_kind"), c("published_at"), c("fetched_at"), cutoff))
        .withColumn("social", S.social_score(c("hn_points"), c("reddit_upvotes"), c("github_stars")))
        .withColumn("base_score", F.coalesce("final_score", "global_score"))
        .withColumn("coverage_score", S.log_share(F.lit(1), 8))
    )
    return OF.followed_scores(readers, followed, cut_lineage(OF.item_rows(rows, "base_score")))


RELEVANCE = [*sql_anchor_sims("articles", "article_id", "title"),
             f"relevance AS (SELECT id AS article_id, {B.clamp('(max(sim) - 0.15) / 0.35')} AS relevance FROM sims GROUP BY 1)"]


@query("c33_relevance", B.with_(B.ARTICLES, *RELEVANCE) + "SELECT article_id, round(relevance, 6) AS relevance FROM relevance")
def c33(spark, sf):
    rows = FT.with_anchor_similarity(D.articles(spark, sf, text="title").select("article_id", "title"), c("title"), "sims")
    return rows.select("article_id", r6(FT.relevance(c("sims"))).alias("relevance"))


SQL_KEYWORD = B.clamp(" + ".join(f"CASE WHEN contains(lower(title), {B.q(p)}) THEN {w} ELSE 0 END" for p, w in K.KEYWORD_WEIGHTS.items()))


@query("c34_keyword_score", A + f"SELECT article_id, round({SQL_KEYWORD}, 6) AS score FROM articles")
def c34(spark, sf):
    return D.articles(spark, sf, text="title").select("article_id", r6(S.keyword_score(c("title"))).alias("score"))


@query("c35_social_score", A + f"SELECT article_id, round({SQL_SOCIAL}, 6) AS score FROM articles")
def c35(spark, sf):
    return D.articles(spark, sf, text=False).select(
        "article_id", r6(S.social_score(c("hn_points"), c("reddit_upvotes"), c("github_stars"))).alias("score")
    )


TRIAGE = [
    B.ARTICLES, *RELEVANCE,
    f"triage AS (SELECT a.*, relevance, source_no % 7 = 0 AS always_scrape, round(100 * {B.clamp(f'0.35 * authority + 0.30 * relevance + 0.20 * {SQL_KEYWORD} + 0.15 * {SQL_SOCIAL}')}, 6) AS pre_score FROM articles a JOIN relevance USING (article_id))",
    "decided AS (SELECT *, CASE WHEN always_scrape THEN 'always_scrape' WHEN relevance >= 0.75 AND ("
    + " OR ".join(f"contains(lower(title), '{w}')" for w in K.FORCE_FETCH_WORDS)
    + ") THEN 'ai_relevance_force_fetch' WHEN pre_score >= 70 THEN 'pre_score>=70' WHEN pre_score >= 40 THEN 'pre_score>=40' "
    "WHEN pre_score >= 30 AND (authority >= 0.7 OR relevance >= 0.6) THEN 'watch_band' ELSE 'below_threshold_skip' END AS reason FROM triage)",
]
SQL_DECISION = (
    "CASE reason WHEN 'pre_score>=70' THEN 'fetch_full_priority' WHEN 'watch_band' THEN 'fetch_watch' WHEN 'below_threshold_skip' THEN 'skip' ELSE 'fetch_full' END"
)


def triaged(spark, sf):
    from newsgraph.operators.triage import with_triage

    rows = D.articles(spark, sf).withColumn("always_scrape", F.pmod("source_no", F.lit(7)) == 0)
    return with_triage(rows)


@query("c36_pre_score", B.with_(*TRIAGE) + "SELECT article_id, pre_score FROM triage")
def c36(spark, sf):
    return triaged(spark, sf).select("article_id", "pre_score")


@query("c37_scrape_decision", B.with_(*TRIAGE) + f"SELECT article_id, {SQL_DECISION} AS decision, reason FROM decided")
def c37(spark, sf):
    return triaged(spark, sf).select("article_id", "decision", "reason")
