"""W and Q rows: top-k, caps, interleaving, feeds, digests and composite queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgraph import constants as K
from newsgraph.catalog import sqlbase as B
from newsgraph.catalog.scalars import SQL_EVENT_TIME, SQL_SHOWN_SOURCE, _CATEGORY, sql_evergreen, sql_fresh
from newsgraph.catalog.scores import (
    CLUSTER, DOMAIN, NOW, READERS, SQL_DECISION, SQL_EDITORIAL, SQL_SOCIAL, TRIAGE, sql_personal, triaged,
)
from newsgraph.functions import cards as CD, maps, scoring as S
from newsgraph.operators import aggregates as AG, digest as DG, people, ranking as R, triage as TG
from newsgraph.operators.diversity import mmr
from newsgraph.plans import feed as FD
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


mod = lambda x, n: F.pmod(c(x), F.lit(n))
now_of = lambda spark, sf: F.lit(as_of(spark, sf))
A = B.with_(B.ARTICLES)

_DONE = "done AS (SELECT doc_id AS article_id FROM labels)"
_TARGET_ORDER = "ORDER BY coalesce(published_at, fetched_at) DESC, pre_score DESC NULLS LAST, article_id"


@query(
    "w01_scrape_targets",
    B.with_(*TRIAGE, _DONE)
    + f"""SELECT article_id, band, row_number() OVER (PARTITION BY band {_TARGET_ORDER}) AS pos FROM (SELECT *, CASE WHEN {SQL_DECISION} = 'fetch_watch' THEN 'watch' WHEN {SQL_DECISION} <> 'skip' THEN 'full' END AS band
 FROM decided WHERE article_id NOT IN (SELECT article_id FROM done)) WHERE band IS NOT NULL QUALIFY pos <= CASE band WHEN 'full' THEN 50 ELSE 15 END""",
)
def w01(spark, sf):
    done = table(spark, sf, "labels").select(c("doc_id").alias("article_id"))
    return TG.scrape_targets(triaged(spark, sf), done).select("article_id", "band", "pos")


@query(
    "w02_scrape_targets_by_kind",
    B.with_(*TRIAGE, _DONE)
    + f"""SELECT article_id, source_kind, row_number() OVER (PARTITION BY source_kind {_TARGET_ORDER}) AS pos FROM decided
 WHERE article_id NOT IN (SELECT article_id FROM done) AND {SQL_DECISION} IN ('fetch_full', 'fetch_full_priority') QUALIFY pos <= 50""",
)
def w02(spark, sf):
    done = table(spark, sf, "labels").select(c("doc_id").alias("article_id"))
    return TG.scrape_targets_by_kind(triaged(spark, sf), done).select("article_id", "source_kind", "pos")


_TOP = f"""scored AS (SELECT *, round_even(global_score * pow(2.0, -{B.hours(SQL_EVENT_TIME, NOW)} / CASE WHEN content_type = 'github' THEN 48.0 ELSE {B.lookup(K.HALF_LIFE_HOURS, 'event_type', '18.0')} END), 2) AS decayed,
  ({SQL_EVENT_TIME}) AS event_time FROM articles WHERE {sql_fresh(NOW + ' - INTERVAL 168 HOUR')})"""


@query(
    "w03_top_sources",
    B.with_(B.ARTICLES, _TOP)
    + """SELECT source_name, count(*) AS coverage, count(DISTINCT cluster_id) AS clusters, epoch_us(min(event_time)) AS first_us, epoch_us(max(event_time)) AS last_us, max(decayed) AS top_score,
 md5(arg_max(title, (decayed, -article_id))) AS headline_md5 FROM scored WHERE event_time IS NOT NULL GROUP BY 1 ORDER BY top_score DESC, source_name LIMIT 80""",
)
def w03(spark, sf):
    """Top sources of the window by decayed score."""
    now = now_of(spark, sf)
    cutoff = now - F.expr("INTERVAL 168 HOURS")
    rows = D.articles(spark, sf, text="title").filter(S.is_fresh(c("source_kind"), c("published_at"), c("fetched_at"), cutoff))
    rows = rows.withColumn("event_time", S.event_time(c("source_kind"), c("published_at"), c("fetched_at"))).filter("event_time is not null")
    decayed = S.decayed_rank(c("global_score"), c("event_type"), S.hours_between(c("event_time"), now), c("content_type"))
    per = rows.withColumn("decayed", decayed).groupBy("source_name", "cluster_id").agg(
        F.count("*").alias("n"), F.min("event_time").alias("first"), F.max("event_time").alias("last"),
        F.max(F.struct("decayed", (-c("article_id")).alias("tie"), "title")).alias("top"),
    )
    stats = per.groupBy("source_name").agg(
        F.sum("n").alias("coverage"), F.count("cluster_id").alias("clusters"), F.min("first").alias("f"), F.max("last").alias("l"), F.max("top").alias("top")
    )
    return (
        stats.select(
            "source_name", "coverage", "clusters", F.unix_micros("f").alias("first_us"), F.unix_micros("l").alias("last_us"),
            c("top.decayed").alias("top_score"), F.md5("top.title").alias("headline_md5"),
        )
        .orderBy(F.desc("top_score"), "source_name")
        .limit(80)
    )


_RANKED_TAB = """tab AS (SELECT article_id, source_name, content_type, global_score, row_number() OVER (PARTITION BY content_type ORDER BY global_score DESC, article_id) AS p FROM articles)"""


def tab_rows(spark, sf):
    rows = D.articles(spark, sf, text=False)
    return rows.withColumn("ord", F.struct((-c("global_score")).alias("a"), c("article_id").alias("b")))


@query(
    "w04_source_cap",
    B.with_(B.ARTICLES, _RANKED_TAB)
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY content_type, source_name ORDER BY p) > 4 AS over FROM tab)
SELECT content_type, article_id, row_number() OVER (PARTITION BY content_type ORDER BY over, p) AS slot FROM r QUALIFY slot <= 30""",
)
def w04(spark, sf):
    rows = tab_rows(spark, sf).select("content_type", "article_id", "source_name", "ord")
    return R.soft_cap(rows, ["content_type"], "source_name", "ord", 4, 30).select("content_type", "article_id", "slot")


@query(
    "w05_category_interleave",
    B.with_(B.ARTICLES, B.TOPIC_ROWS, _CATEGORY)
    + f""", r AS (SELECT source_name, article_id, category, global_score, row_number() OVER (PARTITION BY source_name, category ORDER BY global_score DESC, article_id) AS rd,
 count(*) OVER (PARTITION BY source_name) AS n FROM articles JOIN categories USING (article_id))
SELECT source_name, article_id, row_number() OVER (PARTITION BY source_name ORDER BY CASE WHEN n <= 12 THEN 0 ELSE rd END, CASE WHEN n <= 12 THEN 0 ELSE list_position({B.arr(K.CATEGORY_PRIORITY)}, category) END, global_score DESC, article_id) AS slot FROM r QUALIFY slot <= 12""",
)
def w05(spark, sf):
    rows = tab_rows(spark, sf).withColumn("category", CD.category(c("event_type"), c("topics")))
    priority = maps.lookup({n: i for i, n in enumerate(K.CATEGORY_PRIORITY)}, c("category"), 99)
    return R.interleave(rows, ["source_name"], "category", priority, [F.desc("global_score"), F.asc("article_id")], "ord", 12).select(
        "source_name", "article_id", "slot"
    )


@query(
    "w06_backfill",
    B.with_(B.ARTICLES, _RANKED_TAB)
    + """, sel AS (SELECT * FROM tab WHERE global_score >= 60 AND article_id % 5 = 0 QUALIFY row_number() OVER (PARTITION BY content_type ORDER BY p) <= 8),
 spare AS (SELECT * FROM tab WHERE global_score < 60), used AS (SELECT content_type, source_name, count(*) AS u FROM sel GROUP BY ALL), have AS (SELECT content_type, count(*) AS h FROM sel GROUP BY 1),
 r AS (SELECT s.*, coalesce(u, 0) + row_number() OVER (PARTITION BY content_type, source_name ORDER BY p) > 2 AS second FROM spare s LEFT JOIN used USING (content_type, source_name))
SELECT content_type, article_id, row_number() OVER (PARTITION BY content_type ORDER BY second, p) AS fill FROM r LEFT JOIN have USING (content_type) QUALIFY fill <= 20 - coalesce(h, 0)""",
)
def w06(spark, sf):
    rows = tab_rows(spark, sf).select("content_type", "article_id", "source_name", "global_score", "ord")
    chosen = R.top_per_group(rows.filter((c("global_score") >= 60) & (mod("article_id", 5) == 0)), ["content_type"], [F.asc("ord")], 8)
    spare = rows.filter("global_score < 60")
    return R.backfill(chosen, spare, ["content_type"], "article_id", "source_name", [F.asc("ord")], 30).select("content_type", "article_id", "fill")


@query(
    "w07_serendipity",
    B.with_(B.ARTICLES, _RANKED_TAB)
    + """, sel AS (SELECT * FROM tab WHERE p % 2 = 1 AND p <= 40), have AS (SELECT content_type, count(*) AS h FROM sel GROUP BY 1),
 left_over AS (SELECT *, row_number() OVER (PARTITION BY content_type ORDER BY p) AS rn FROM tab WHERE global_score >= 75 AND (content_type, article_id) NOT IN (SELECT (content_type, article_id) FROM sel))
SELECT content_type, article_id FROM left_over LEFT JOIN have USING (content_type) WHERE rn <= greatest(1, round_even(0.15 * coalesce(h, 0), 0))""",
)
def w07(spark, sf):
    rows = tab_rows(spark, sf).select("content_type", "article_id", "global_score", "ord").withColumn("share", F.lit(0.15))
    top = R.top_per_group(rows, ["content_type"], [F.asc("ord")], 40, "p")
    chosen = top.filter("p % 2 = 1").select("content_type", "article_id")
    return R.serendipity(rows, chosen, ["content_type"], "article_id", "share", c("global_score") >= 75, "ord", 40).select("content_type", "article_id")


def digest_rows(spark, sf):
    o = table(spark, sf, "orders")
    k = c("o_orderkey")
    return o.select(
        c("o_custkey").alias("user_id"), c("o_orderdate").alias("date"),
        F.when(F.pmod(k, F.lit(3)) == 0, "longform").otherwise("news").alias("content_type"),
        F.when(F.pmod(k, F.lit(4)) != 0, c("o_orderpriority")).alias("headline"), F.when(F.pmod(k, F.lit(5)) != 0, c("o_orderstatus")).alias("executive_summary"),
        F.when(F.pmod(k, F.lit(2)) == 0, F.lit("<p>x</p>")).alias("longform_html"),
        F.when(F.pmod(k, F.lit(7)) == 0, F.concat(F.lit("p/"), k.cast("string"))).alias("storage_path"), k.alias("id"),
    )


_DIG = """dig AS (SELECT o_custkey AS user_id, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 3 = 0 THEN 'longform' ELSE 'news' END AS content_type, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS headline,
 CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS summary, CASE WHEN o_orderkey % 2 = 0 THEN '<p>x</p>' END AS html, CASE WHEN o_orderkey % 7 = 0 THEN 'p/' || o_orderkey END AS path, o_orderkey AS id FROM orders)"""


@query(
    "w08_digest_archive",
    B.with_(_DIG) + """SELECT user_id, strftime(day, '%Y-%m-%d') AS day, headline, subtitle FROM (SELECT user_id, day, arg_max(coalesce(headline, 'Daily AI Digest'), id) AS headline, arg_max(coalesce(summary, ''), id) AS subtitle FROM dig
 WHERE content_type = 'longform' AND (html IS NOT NULL OR path IS NOT NULL) GROUP BY ALL) ORDER BY day DESC, user_id LIMIT 30""",
)
def w08(spark, sf):
    rows = digest_rows(spark, sf).filter((c("content_type") == "longform") & (c("longform_html").isNotNull() | c("storage_path").isNotNull()))
    # One digest per reader and day, as the table's key demands: the last written one.
    one = rows.groupBy("user_id", F.to_date("date").alias("date")).agg(F.max_by(F.struct("content_type", "headline", "executive_summary", "longform_html", "storage_path"), "id").alias("r")).select("user_id", "date", "r.*")
    return DG.archive(one).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "headline", "subtitle")


@query(
    "w09_daily_digest",
    B.with_(_DIG) + """SELECT id, CASE WHEN h IS NOT NULL THEN coalesce(a_head, headline) END AS headline, h IS NOT NULL AS available FROM (
 SELECT id, headline, CASE WHEN path IS NOT NULL AND id % 2 = 1 THEN 'Stored ' || id END AS a_head, coalesce(CASE WHEN path IS NOT NULL AND id % 2 = 1 THEN '<b/>' END, html) AS h FROM dig WHERE content_type = 'longform')""",
)
def w09(spark, sf):
    rows = digest_rows(spark, sf)
    arts = rows.filter(c("storage_path").isNotNull() & (c("id") % 2 == 1)).select(
        c("storage_path").alias("path"), F.concat(F.lit("Stored "), c("id").cast("string")).alias("headline"), F.lit(None).cast("string").alias("subtitle"), F.lit("<b/>").alias("longform_html")
    )
    # The row id rides along in place of the reader to make every row visible.
    return DG.daily(rows.withColumn("user_id", c("id")), arts).select(c("user_id").alias("id"), "headline", "available")


@query("w10_breaking_item", A + "SELECT source_name, arg_min(article_id, (-global_score, article_id)) AS article_id FROM articles WHERE global_score >= 60 GROUP BY 1")
def w10(spark, sf):
    rows = D.articles(spark, sf, text=False).select(
        c("source_name").alias("user_id"), "article_id", (c("global_score") >= 60).alias("urgent"),
        F.struct((-c("global_score")).alias("a"), c("article_id").alias("b")).alias("place"),
    )
    return FD.breaking(rows).select(c("user_id").alias("source_name"), "article_id")


@query("w11_cluster_articles", A + "SELECT cluster_id, article_id, row_number() OVER (PARTITION BY cluster_id ORDER BY -global_score, article_id) AS pos FROM articles WHERE cluster_id IS NOT NULL")
def w11(spark, sf):
    rows = D.articles(spark, sf, text=False).filter(c("cluster_id").isNotNull()).select("cluster_id", "article_id", (-c("global_score")).alias("order_score"))
    return R.rank_all(rows, ["cluster_id"], ["order_score", "article_id"], "pos").select("cluster_id", "article_id", "pos")


@query("w12_primary_entity", B.with_(B.ENTITY_ROWS) + "SELECT article_id, entity FROM entity_rows QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY weight DESC, entity) = 1")
def w12(spark, sf):
    first = F.try_element_at(maps.ranked_entries(c("entities")), F.lit(1))["name"]
    return D.article_tags(spark, sf).select("article_id", first.alias("entity")).filter(c("entity").isNotNull())


@query("w13_longform_input", A + "SELECT cluster_id, article_id, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(final_score, global_score) DESC, article_id) AS pos FROM articles WHERE cluster_id IS NOT NULL QUALIFY pos <= 30")
def w13(spark, sf):
    rows = D.articles(spark, sf, text=False).filter(c("cluster_id").isNotNull()).withColumn("s", F.coalesce("final_score", "global_score"))
    return R.top_per_group(rows, ["cluster_id"], [F.desc("s"), F.asc("article_id")], 30, "pos").select("cluster_id", "article_id", "pos")


@query("w14_tab_counts", A + "SELECT 'all' AS tab, count(*) AS items, max(global_score) AS best FROM articles UNION ALL SELECT content_type, count(*), max(global_score) FROM articles GROUP BY 1")
def w14(spark, sf):
    rows = D.articles(spark, sf, text=False).select(F.explode(F.array(F.lit("all"), c("content_type"))).alias("tab"), "global_score")
    return rows.groupBy("tab").agg(F.count("*").alias("items"), F.max("global_score").alias("best"))


_HEAD = B.lookup(DG.EMPTY_HEADLINES, "tab", "'Daily AI Pulse'")


@query(
    "w15_section_copy",
    A + f""", tabs AS (SELECT DISTINCT cluster_id, unnest(['all', 'news', 'research', 'github']) AS tab FROM articles WHERE cluster_id IS NOT NULL),
 its AS (SELECT cluster_id, unnest(['all', content_type]) AS tab, title, global_score, article_id FROM articles WHERE cluster_id IS NOT NULL),
 f AS (SELECT cluster_id, tab, arg_min(title, (-global_score, article_id)) AS title FROM its GROUP BY ALL)
SELECT cluster_id, tab, md5(coalesce(title, {_HEAD})) AS headline_md5, CASE WHEN title IS NULL THEN 'No ' || tab || ' updates from the last 24 hours.' ELSE 'Key AI ' || tab || ' updates from the last 24 hours.' END AS summary FROM tabs LEFT JOIN f USING (cluster_id, tab)""",
)
def w15(spark, sf):
    rows = D.articles(spark, sf).filter(c("cluster_id").isNotNull()).select(
        "cluster_id", F.explode(F.array(F.lit("all"), c("content_type"))).alias("tab"), "title", F.lit(None).cast("string").alias("summary"),
        F.struct((-c("global_score")).alias("a"), c("article_id").alias("b")).alias("pos"),
    )
    return DG.section_copy(rows, ["cluster_id"], "tab", "pos").select("cluster_id", "tab", F.md5("headline").alias("headline_md5"), "summary")


def recursive(*parts: str) -> str:
    return B.with_(*parts).replace("WITH", "WITH RECURSIVE", 1)


def sql_mmr(good: str, limit: int, pool: int, p: str = "") -> list[str]:
    """Greedy choice as recursion, one pick a step: (user_id, pick, article_id, chosen) in ``{p}pick``.  ``good`` has user_id, article_id, rank_score."""
    dot = "list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
    return [
        f"{p}pool AS MATERIALIZED (SELECT user_id, article_id, rank_score, row_number() OVER (PARTITION BY user_id ORDER BY rank_score DESC, article_id) AS rk FROM {good} QUALIFY rk <= {pool})",
        f"{p}vec AS MATERIALIZED (SELECT DISTINCT article_id, embedding FROM {p}pool JOIN embeddings ON vec_id = article_id % (SELECT count(*) FROM embeddings))",
        f"{p}near AS MATERIALIZED (SELECT x.article_id AS a, y.article_id AS b, {dot} AS s FROM {p}vec x, {p}vec y WHERE EXISTS (SELECT 1 FROM {p}pool u JOIN {p}pool w USING (user_id) WHERE u.article_id = x.article_id AND w.article_id = y.article_id))",
        f"{p}sims AS MATERIALIZED (SELECT u.user_id, u.rk, list(s ORDER BY w.rk) AS sims FROM {p}pool u JOIN {p}pool w USING (user_id) JOIN {p}near ON a = u.article_id AND b = w.article_id GROUP BY ALL)",
        f"""{p}pick(user_id, pick, article_id, chosen) AS (SELECT user_id, 1, article_id, [rk] FROM {p}pool WHERE rk = 1 UNION ALL
  SELECT user_id, pick + 1, article_id, list_append(chosen, rk) FROM (SELECT k.user_id, k.pick, k.chosen, o.article_id, o.rk,
    row_number() OVER (PARTITION BY k.user_id ORDER BY round(0.8 * o.rank_score - (1 - 0.8) * list_max(list_transform(k.chosen, lambda j: m.sims[j])), 9) DESC, o.rk) AS rn
   FROM {p}pick k JOIN {p}pool o ON o.user_id = k.user_id AND NOT list_contains(k.chosen, o.rk) JOIN {p}sims m ON m.user_id = o.user_id AND m.rk = o.rk WHERE k.pick < {limit}) t WHERE rn = 1)""",
    ]


def sql_choose(cand: str, limit: int, cap: int | None, eligible: str | None, pool: int | None = None, p: str = "") -> list[str]:
    """Selection, serendipity, source cap and backfill as in the plan: (user_id, article_id, slot) in ``{p}chosen``."""
    parts = [f"{p}good AS (SELECT * FROM {cand} WHERE user_score >= min_score)", *sql_mmr(f"{p}good", limit, pool or 2 * limit, p)]
    order = f"SELECT user_id, article_id, pick AS pos FROM {p}pick"
    if eligible:
        parts.append(f"""{p}extra AS (SELECT user_id, article_id, {limit} + row_number() OVER (PARTITION BY user_id ORDER BY rank_score DESC, article_id) AS pos FROM (
  SELECT g.*, h, row_number() OVER (PARTITION BY g.user_id ORDER BY rank_score DESC, article_id) AS rn FROM {p}good g LEFT JOIN (SELECT user_id, count(*) AS h FROM {p}pick GROUP BY 1) n ON n.user_id = g.user_id
  WHERE {eligible} AND serendipity > 0 AND (g.user_id, article_id) NOT IN (SELECT (user_id, article_id) FROM {p}pick)) t WHERE rn <= greatest(1, round_even(serendipity * coalesce(h, 0), 0)))""")
        order += f" UNION ALL SELECT user_id, article_id, pos FROM {p}extra"
    parts.append(f"{p}ord AS (SELECT o.*, shown_source FROM ({order}) o JOIN {p}good g ON g.user_id = o.user_id AND g.article_id = o.article_id)")
    if cap is None:
        return [*parts, f"{p}chosen AS (SELECT user_id, article_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS slot FROM {p}ord QUALIFY slot <= {limit})"]
    return [
        *parts,
        f"{p}over AS (SELECT *, row_number() OVER (PARTITION BY user_id, shown_source ORDER BY pos) > {cap} AS over FROM {p}ord)",
        f"{p}capped AS (SELECT user_id, article_id, shown_source, row_number() OVER (PARTITION BY user_id ORDER BY over, pos) AS slot FROM {p}over QUALIFY slot <= {limit})",
        f"{p}used AS (SELECT user_id, shown_source, count(*) AS u FROM {p}capped GROUP BY ALL)",
        f"{p}have AS (SELECT user_id, count(*) AS h FROM {p}capped GROUP BY 1)",
        f"""{p}spare AS (SELECT s.*, coalesce(u, 0) + row_number() OVER (PARTITION BY s.user_id, s.shown_source ORDER BY rank_score DESC, article_id) > 2 AS second
  FROM {cand} s LEFT JOIN {p}used x ON x.user_id = s.user_id AND x.shown_source = s.shown_source WHERE user_score < min_score)""",
        f"""{p}fill AS (SELECT s.user_id, article_id, coalesce(h, 0) + row_number() OVER (PARTITION BY s.user_id ORDER BY second, rank_score DESC, article_id) AS slot FROM {p}spare s LEFT JOIN {p}have n ON n.user_id = s.user_id
  QUALIFY slot <= {min(limit, 20)})""",
        f"{p}chosen AS (SELECT user_id, article_id, slot FROM {p}capped UNION ALL SELECT user_id, article_id, slot FROM {p}fill)",
    ]


@query(
    "k06_mmr",
    recursive("scored AS (SELECT label AS user_id, vec_id AS article_id, value / 500 AS rank_score FROM embeddings JOIN events ON event_id = vec_id)", *sql_mmr("scored", 30, 60))
    + "SELECT user_id AS label, article_id, CAST(pick AS INTEGER) AS pick FROM pick",
)
def k06(spark, sf):
    rows = D.vectors(spark, sf).join(table(spark, sf, "events").select(c("event_id").alias("article_id"), "value"), "article_id").select("label", "article_id", (c("value") / 500).alias("score"))
    return mmr(rows, D.vectors(spark, sf), ["label"], "article_id", "score", 30)


# --- composite --------------------------------------------------------------------------------


def cluster_view(spark, sf):
    i = c("cluster_id")
    return AG.cluster_stats(D.articles(spark, sf, text=False)).select(
        "cluster_id", "coverage_count", "sources_count", c("sources_count").alias("independent_count"), "max_score", "last_seen", "top_article_id",
        (F.pmod(i, F.lit(3)) == 0).alias("official"), F.pmod(i * 7, F.lit(90)).cast("double").alias("trust"),
    )


def story_rows(spark, sf):
    return D.articles(spark, sf, text=False).withColumn("urgent", c("global_score") >= 60)


def one_reader(spark):
    return people.without_weights(D.default_reader(spark)).first()


_DEFAULT = """reader AS (SELECT 0 AS user_id, 1.0 AS p1, 1.0 AS p2, 1.0 AS p3, 1.0 AS p4, 1.0 AS p5, 1.0 AS p6, false AS p_official, 1.0 AS credibility, 1.0 AS hype, 1.0 AS recency, 55.0 AS min_show,
 '-' AS w_entity, 1.0 AS w_entity_w, false AS w_entity_b, '-' AS w_topic, 1.0 AS w_topic_w, false AS w_topic_b, '-' AS w_source, 1.0 AS w_source_w, false AS w_source_b)"""
_BASE = "coalesce(final_score, global_score)"


def sql_context(source: str, hours: int) -> str:
    edit = SQL_EDITORIAL.format(top=f"coalesce(nullif(top_score, 0), {_BASE})", cov="coverage", ind="sources", off="a.cluster_id % 3 = 0", trust="((a.cluster_id * 7) % 90)")
    return f"""ctx AS (SELECT * FROM (SELECT a.*, d.* EXCLUDE (article_id), {_BASE} AS base_score, {SQL_EVENT_TIME} AS event_time, {B.hours(f'({SQL_EVENT_TIME})', NOW)} AS age_hours, {SQL_SOCIAL} AS social, {B.official('final_url')} AS off,
  {B.log_share('coalesce(s.sources, 1)', 8)} AS cov, CASE WHEN s.cluster_id IS NOT NULL THEN {edit} ELSE {_BASE} END AS editorial_rank,
  NULL::DOUBLE AS me, NULL::DOUBLE AS mt FROM {source} a LEFT JOIN cstats s USING (cluster_id) JOIN domain d USING (article_id)) WHERE event_time IS NOT NULL AND age_hours >= 0 AND age_hours <= {hours})"""


_LIVE = [
    B.ARTICLES, B.TOPIC_ROWS, CLUSTER, DOMAIN, _DEFAULT,
    f"fresh AS (SELECT * FROM articles WHERE {sql_fresh(NOW + ' - INTERVAL 24 HOUR')} AND {_BASE} >= 2 AND NOT {sql_evergreen('final_url')})",
    sql_context("fresh", 24),
]


@query(
    "q01_feed_candidates",
    B.with_(*_LIVE) + f"SELECT article_id, user_score, round(user_score * pow(2.0, -age_hours / 18), 6) AS rank_score, CAST(round_even(user_score, 0) AS INTEGER) AS shown_score FROM (SELECT *, {sql_personal('editorial_rank', 'cov')} AS user_score FROM ctx, reader)",
)
def q01_candidates(spark, sf):
    rows = FD.live_candidates(story_rows(spark, sf), cluster_view(spark, sf), one_reader(spark), now_of(spark, sf))
    return rows.select("article_id", "user_score", "rank_score", "shown_score")


def sql_cards(base: str, half_life: float) -> str:
    """Scored rows with their card fields, for the default reader."""
    return f"""cand AS (SELECT *, round(user_score * pow(2.0, -age_hours / {half_life}), 6) AS rank_score, CAST(round_even(user_score, 0) AS INTEGER) AS shown_score, min_show AS min_score, 0.15 AS serendipity,
  {SQL_SHOWN_SOURCE} AS shown_source, global_score >= 60 AS urgent FROM (SELECT ctx.*, reader.*, category, {sql_personal(base, 'cov')} AS user_score FROM ctx JOIN categories USING (article_id), reader) t)"""


@query(
    "q01_live_feed",
    recursive(*_LIVE, _CATEGORY, sql_cards("editorial_rank", 18), *sql_choose("cand", 30, 4, "shown_score >= 75"))
    + "SELECT slot, article_id, shown_score, category, shown_source, content_type FROM chosen JOIN cand USING (article_id)",
)
def q01(spark, sf):
    rows = FD.live_feed(story_rows(spark, sf), cluster_view(spark, sf), D.article_vectors(spark, sf), one_reader(spark), now_of(spark, sf))
    return rows.select("slot", "article_id", "shown_score", "category", "shown_source", "content_type")


_WEEK = [
    B.ARTICLES, B.TOPIC_ROWS, CLUSTER, DOMAIN, _DEFAULT,
    f"tops AS (SELECT top_article FROM cstats WHERE last_seen >= {NOW} - INTERVAL 7 DAY)",
    f"best AS (SELECT * FROM articles WHERE article_id IN (SELECT top_article FROM tops) AND {_BASE} >= 30 ORDER BY {_BASE} DESC, article_id LIMIT 200)",
    f"kept AS (SELECT * FROM best WHERE NOT {sql_evergreen('final_url')})",
    sql_context("kept", 168),
]


@query(
    "q02_weekly_candidates",
    B.with_(*_WEEK) + f"SELECT article_id, user_score, round(user_score * pow(2.0, -age_hours / 72), 6) AS rank_score FROM (SELECT *, {sql_personal('editorial_rank', 'cov')} AS user_score FROM ctx, reader)",
)
def q02_candidates(spark, sf):
    rows = FD.weekly_candidates(story_rows(spark, sf), cluster_view(spark, sf), one_reader(spark), now_of(spark, sf))
    return rows.select("article_id", "user_score", "rank_score")


@query(
    "q02_weekly_top",
    recursive(*_WEEK, _CATEGORY, sql_cards("editorial_rank", 72), *sql_choose("cand", 20, 3, None))
    + "SELECT slot, article_id, shown_score, category, shown_source FROM chosen JOIN cand USING (article_id)",
)
def q02(spark, sf):
    rows = FD.weekly_top(story_rows(spark, sf), cluster_view(spark, sf), D.article_vectors(spark, sf), one_reader(spark), now_of(spark, sf))
    return rows.select("slot", "article_id", "shown_score", "category", "shown_source")


_TODAY_TABS = {"m": ("base_score >= 2", "min_show", 30), "n": ("base_score >= 2 AND content_type = 'news'", "min_show", 10),
               "r": ("base_score >= 1 AND content_type = 'research'", "least(min_show, 25.0)", 10), "g": ("base_score >= 1 AND content_type = 'github'", "least(min_show, 25.0)", 10)}
_TODAY = [
    *_LIVE[:-2], _LIVE[-2].replace(f"{_BASE} >= 2", f"{_BASE} >= 1"), _LIVE[-1], _CATEGORY, sql_cards("editorial_rank", 18),
    *[part for t, (where, least, limit) in _TODAY_TABS.items() for part in (
        f"{t}cand AS (SELECT * REPLACE ({least} AS min_score) FROM cand WHERE {where})", *sql_choose(f"{t}cand", limit, 4, "shown_score >= 75", p=t))],
    "mixed AS (SELECT x.*, slot, count(*) OVER () AS n, row_number() OVER (PARTITION BY category ORDER BY shown_score DESC, slot) AS rd FROM mchosen JOIN cand x USING (article_id))",
    f"""spread AS (SELECT article_id, row_number() OVER (ORDER BY CASE WHEN n <= 12 THEN 0 ELSE rd END, CASE WHEN n <= 12 THEN 0 ELSE coalesce(list_position({B.arr(K.CATEGORY_PRIORITY)}, category), 99) END, shown_score DESC, slot) AS place
  FROM mixed WHERE rd <= 12 QUALIFY place <= 12)""",
    "lists AS (SELECT article_id, place AS slot, 0 AS list_no FROM spread UNION ALL SELECT article_id, slot, 1 FROM nchosen UNION ALL SELECT article_id, slot, 2 FROM rchosen UNION ALL SELECT article_id, slot, 3 FROM gchosen)",
    "firsts AS (SELECT * FROM lists QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY list_no, slot) = 1)",
]


@query(
    "q03_today",
    recursive(*_TODAY) + "SELECT row_number() OVER (ORDER BY list_no, slot) AS place, article_id, category, content_type, shown_score, urgent, list_no FROM firsts JOIN cand USING (article_id)",
)
def q03(spark, sf):
    items = FD.today(story_rows(spark, sf), cluster_view(spark, sf), D.article_vectors(spark, sf), one_reader(spark), now_of(spark, sf))
    return items.select("place", "article_id", "category", "content_type", "shown_score", "urgent", "list_no")


def pool_of(spark, sf):
    from newsgraph.session import cut_lineage

    # At most POOL rows; every later step starts from them.
    return cut_lineage(FD.digest_pool(story_rows(spark, sf), cluster_view(spark, sf), D.article_vectors(spark, sf), now_of(spark, sf)))


def readers_of(spark, sf):
    return people.with_weights(D.readers(spark, sf), D.reader_weights(spark, sf))


_POOL = [
    B.ARTICLES, B.TOPIC_ROWS, B.ENTITY_ROWS, CLUSTER, DOMAIN, READERS,
    f"fresh AS (SELECT * FROM articles WHERE {sql_fresh(NOW + ' - INTERVAL 24 HOUR')} AND (final_score >= 30 OR global_score >= 30) ORDER BY {_BASE} DESC, article_id LIMIT 300)",
    sql_context("fresh", 24),
    f"""offers AS (SELECT r.*, x.* EXCLUDE (me, mt), (SELECT max(weight) FROM entity_rows e WHERE e.article_id = x.article_id AND e.entity = r.w_entity) AS me,
 (SELECT max(weight) FROM topic_rows t WHERE t.article_id = x.article_id AND t.topic = r.w_topic) AS mt FROM ctx x CROSS JOIN readers r)""",
]


@query(
    "j11_reader_offers",
    B.with_(*_POOL) + f"SELECT user_id, article_id, user_score FROM (SELECT *, {sql_personal('base_score', 'cov')} AS user_score FROM offers) WHERE user_score >= min_show",
)
def j11(spark, sf):
    return FD.offers(pool_of(spark, sf), readers_of(spark, sf)).select("user_id", "article_id", "user_score")


_DIGESTS = [
    *_POOL,
    f"""cand AS (SELECT *, min_show AS min_score, 'x' AS shown_source, round_even(user_score / greatest(recency, 0.01) * pow(2.0, -age_hours / CASE WHEN content_type = 'github' THEN 48.0 ELSE {B.lookup(K.HALF_LIFE_HOURS, 'event_type', '18.0')} END), 2) AS rank_score
  FROM (SELECT *, {sql_personal('base_score', 'cov')} AS user_score FROM offers) t)""",
    *sql_choose("cand", 30, None, "base_score >= 75", pool=300),
]


@query("q04_reader_digests", recursive(*_DIGESTS) + "SELECT c.user_id, c.article_id, a.content_type, slot FROM chosen c JOIN articles a ON a.article_id = c.article_id")
def q04(spark, sf):
    return FD.reader_digests(pool_of(spark, sf), readers_of(spark, sf), D.article_vectors(spark, sf))


_URG = [
    B.ARTICLES, B.TOPIC_ROWS, CLUSTER, DOMAIN, _DEFAULT,
    f"fresh AS (SELECT * FROM articles WHERE global_score >= 60 AND {sql_fresh(NOW + ' - INTERVAL 72 HOUR')} AND NOT {sql_evergreen('final_url')})",
    sql_context("fresh", 72),
]


@query(
    "q05_urgent_list",
    B.with_(*_URG) + f"SELECT article_id, user_score, row_number() OVER (ORDER BY base_score DESC, article_id) AS pos FROM (SELECT *, {sql_personal('base_score', 'cov')} AS user_score FROM ctx, reader) WHERE user_score >= 60",
)
def q05(spark, sf):
    from pyspark.sql import Row

    reader = Row(**{**one_reader(spark).asDict(recursive=True), "min_urgent_score": 60.0})
    # The stand-in has few items per hour: a window of 72 hours and a threshold of 60.
    return FD.urgent_list(story_rows(spark, sf), cluster_view(spark, sf), reader, now_of(spark, sf), 72).select("article_id", "user_score", "pos")


def view_of(spark, sf):
    from newsgraph.catalog.graphs import graph_articles, graph_nodes, verdict_rows
    from newsgraph.plans.graph_view import graph_view

    links = F.array_join(F.transform("links", lambda x: F.concat_ws(":", x["other"], x["edge_type"], F.round(x["score"] * 1000000).cast("bigint").cast("string"))), "|")
    view = graph_view(graph_nodes(spark, sf), verdict_rows, graph_articles(spark, sf))
    return view.withColumns({"links": links, "articles": F.array_join(c("articles").cast("array<string>"), ",")})


@query("q06_graph_view")
def q06(spark, sf):
    """The whole response; positions come from a decomposition that SQL lacks, all other columns stand in q06_graph_nodes."""
    return view_of(spark, sf)


def _sql_view() -> str:
    from newsgraph.catalog import graphs as GR

    return B.with_(*GR.EDGES, GR._VERD, GR._FUSED, GR._IMPORTANCE) + f""", ftop AS ({GR._FUSED_TOP}),
 ends AS (SELECT graph_id, source AS node, target AS other, edge_type, score FROM ftop UNION ALL SELECT graph_id, target, source, edge_type, score FROM ftop),
 linked AS (SELECT graph_id, node, count(*) AS edges, max(score) AS best_edge,
   string_agg(other || ':' || edge_type || ':' || CAST(round(score * 1000000) AS BIGINT), '|' ORDER BY score DESC, other) AS links FROM ends GROUP BY ALL),
 keys AS (SELECT graph_id, sha256(string_agg(cluster_id, ',' ORDER BY cluster_id)) AS set_key FROM nodes GROUP BY 1),
 best AS (SELECT cluster_id, string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY pos) AS articles FROM (SELECT cluster_id, article_id, row_number() OVER (PARTITION BY cluster_id ORDER BY global_score DESC, article_id) AS pos
   FROM members QUALIFY pos <= 6) t GROUP BY 1)
SELECT i.graph_id, i.cluster_id, coverage AS coverage_count, sources AS sources_count, top_score AS max_score, round(age_hours, 6) AS age_hours, dominant_topic, dominant_event_type, pulsing,
 coalesce((SELECT string_agg(entity, '|' ORDER BY pos) FROM cents x WHERE x.cluster_id = i.cluster_id), '') AS entities, round(importance, 6) AS importance, coalesce(edges, 0) AS edges, best_edge, links, articles, set_key
FROM imp i JOIN keys k ON k.graph_id = i.graph_id LEFT JOIN linked l ON l.graph_id = i.graph_id AND l.node = i.cluster_id LEFT JOIN best b ON b.cluster_id = i.cluster_id"""


@query("q06_graph_nodes", _sql_view())
def q06_nodes(spark, sf):
    return view_of(spark, sf).drop("x", "y")


@query("q07_scoring_pass")
def q07(spark, sf):
    from newsgraph.plans.scoring_pass import score_articles

    return score_articles(D.articles(spark, sf), D.article_vectors(spark, sf), now_of(spark, sf)).select(
        "article_id", "global_score", "verification_state", "trust_label", "final_score", "urgent"
    )


@query(
    "q08_triage",
    B.with_(*TRIAGE, _DONE)
    + f"SELECT {SQL_DECISION} AS decision, reason, count(*) AS items, count(*) FILTER (article_id NOT IN (SELECT article_id FROM done)) AS open, round(max(pre_score), 6) AS best FROM decided GROUP BY ALL",
)
def q08(spark, sf):
    done = table(spark, sf, "labels").select(c("doc_id").alias("article_id"), F.lit(True).alias("_done"))
    rows = triaged(spark, sf).join(done, "article_id", "left")
    return rows.groupBy("decision", "reason").agg(
        F.count("*").alias("items"), F.count_if(c("_done").isNull()).alias("open"), F.round(F.max("pre_score"), 6).alias("best")
    )


@query(
    "q09_week_list",
    recursive(*_WEEK, _CATEGORY, sql_cards("base_score", 72), *sql_choose("cand", 50, None, "base_score >= 75")) + "SELECT slot, article_id, shown_score, base_score FROM chosen JOIN cand USING (article_id)",
)
def q09(spark, sf):
    rows = FD.week_list(story_rows(spark, sf), cluster_view(spark, sf), D.article_vectors(spark, sf), one_reader(spark), now_of(spark, sf))
    return rows.select("slot", "article_id", "shown_score", "base_score")
