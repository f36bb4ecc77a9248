"""J, D and A rows: joins, deduplication and upserts, grouped statistics and log rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgraph import constants as K
from newsgraph.catalog import sqlbase as B
from newsgraph.catalog.scalars import _SHAPE, _STATEMENT, sql_evergreen, sql_key, statements
from newsgraph.catalog.scores import CLUSTER, FINAL, NOW, VERIFY, finals
from newsgraph.functions import cards as CD, features as FT, maps, scoring as S, trust as TR
from newsgraph.operators import aggregates as AG, dedup as DD, logs as LG
from newsgraph.operators.copies import independent_sources
from newsgraph.operators.ranking import top_per_group
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
mod = lambda x, n: F.pmod(c(x), F.lit(n))

# --- joins ------------------------------------------------------------------------------------


@query(
    "j01_star_join",
    "SELECT c_mktsegment, l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem "
    "JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL",
)
def j01(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice", "l_discount")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return (
        items.join(orders, c("o_orderkey") == c("l_orderkey"))
        .join(customers, c("c_custkey") == c("o_custkey"))
        .groupBy("c_mktsegment", "l_returnflag")
        .agg(F.count("*").alias("n"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"))
    )


@query("j02_left_join", "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)")
def j02(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")


@query("j03_anti_join", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j03(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("j04_semi_join", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def j04(spark, sf):
    big = table(spark, sf, "lineitem").filter(c("l_quantity") >= 49).select(c("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(big, "o_orderkey", "left_semi")


@query(
    "j07_distinct_keys",
    B.with_(B.ENTITY_ROWS) + "SELECT DISTINCT entity FROM entity_rows",
)
def j07(spark, sf):
    return D.article_tags(spark, sf).select(F.explode(F.map_keys("entities")).alias("entity")).distinct()


@query(
    "j08_stats_and_top",
    B.with_(B.ARTICLES, CLUSTER) + "SELECT cluster_id, coverage, sources, top_score, top_article FROM cstats",
)
def j08(spark, sf):
    return AG.cluster_stats(D.articles(spark, sf, text=False)).select(
        "cluster_id", c("coverage_count").alias("coverage"), c("sources_count").alias("sources"),
        c("max_score").alias("top_score"), c("top_article_id").alias("top_article"),
    )


@query(
    "j10_dictionary_lookup",
    "SELECT r_name, n_name, count(*) AS suppliers FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL",
)
def j10(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return (
        table(spark, sf, "supplier")
        .join(F.broadcast(nation), c("s_nationkey") == c("n_nationkey"))
        .join(F.broadcast(region), c("n_regionkey") == c("r_regionkey"))
        .groupBy("r_name", "n_name")
        .agg(F.count("*").alias("suppliers"))
    )


# Landed translations of a batch: an array with one object per position, some fields missing.
_LANDED = "(CASE WHEN turn % 4 = 3 THEN '{}' ELSE '{\"text\": \"T' || conv_id || '-' || turn || '\"}' END)"


@query(
    "j13_translation_overlay",
    "WITH t AS (SELECT conv_id, turn, role, text, CASE WHEN turn % 4 <> 3 THEN 'T' || conv_id || '-' || turn END AS tr FROM conversations) "
    "SELECT conv_id, turn, md5(coalesce(tr, text)) AS shown_md5, CASE WHEN bool_and(tr IS NOT NULL) OVER (PARTITION BY conv_id) THEN 'ready' ELSE 'unavailable' END AS status FROM t",
)
def j13(spark, sf):
    from newsgraph.operators.overlay import overlay_translations

    rows = table(spark, sf, "conversations")
    item = F.when(c("turn") % 4 == 3, "{}").otherwise(
        F.concat(F.lit('{"text": "T'), c("conv_id").cast("string"), F.lit("-"), c("turn").cast("string"), F.lit('"}'))
    )
    # One landed reply per (conversation, block of 8 turns), as the sender batched them.
    block = F.floor(c("turn") / 8)
    landed = (
        rows.groupBy("conv_id", block.alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct((c("turn") % 8).cast("int").alias("p"), item.alias("j")))).alias("parts"))
        .select(
            "conv_id", "block", F.transform("parts", lambda p: p["p"]).alias("positions"),
            F.concat(F.lit("["), F.array_join(F.transform("parts", lambda p: p["j"]), ","), F.lit("]")).alias("reply"),
        )
    )
    shown = overlay_translations(rows.withColumn("block", block).withColumn("pos", (c("turn") % 8).cast("int")), landed)
    return shown.select("conv_id", "turn", F.md5("shown").alias("shown_md5"), "status")


# --- dedup and upsert -------------------------------------------------------------------------


def candidate_rows(spark, sf):
    """Pages as candidates: two polls, external ids and hashes that repeat."""
    i = c("page_id")
    return table(spark, sf, "pages").select(
        i, F.concat(F.lit("s"), F.pmod(i, F.lit(5)).cast("string")).alias("source_id"),
        (F.pmod(i, F.lit(60)) + F.pmod(i, F.lit(5))).cast("string").alias("external_id"),
        D.pick(["sitemap", "rss", "rss", "hn"], i).alias("source_kind"),
        F.concat(F.lit("Title "), F.pmod(i, F.lit(80)).cast("string")).alias("title"),
        F.regexp_replace("url", r"/\d+.*$", F.lit("/story")).alias("base"),
        "url",
        F.when(F.pmod(i, F.lit(6)) != 0, F.timestamp_seconds(F.lit(1704067200) + i * 600)).alias("published_at"),
        F.timestamp_seconds(F.lit(1704067200) + i * 600 + 60).alias("fetched_at"),
        F.when(F.pmod(i, F.lit(10)) < 3, 1).otherwise(2).alias("poll"),
    ).withColumn("url", F.concat(c("base"), F.lit("-"), F.pmod(i, F.lit(40)).cast("string"))).drop("base")


_CAND = f"""cand AS (SELECT page_id, 's' || (page_id % 5) AS source_id, CAST(page_id % 60 + page_id % 5 AS VARCHAR) AS external_id,
  {B.pick(["sitemap", "rss", "rss", "hn"], 'page_id')} AS source_kind, 'Title ' || (page_id % 80) AS title,
  regexp_replace(url, '/\\d+.*$', '/story') || '-' || (page_id % 40) AS url,
  CASE WHEN page_id % 6 <> 0 THEN make_timestamp((1704067200 + page_id * 600) * 1000000) END AS published_at,
  make_timestamp((1704067200 + page_id * 600 + 60) * 1000000) AS fetched_at, CASE WHEN page_id % 10 < 3 THEN 1 ELSE 2 END AS poll FROM pages),
hashed AS (SELECT *, sha256(lower(title) || chr(10) || lower(url)) AS h FROM cand WHERE NOT {sql_evergreen('url')} AND (source_kind <> 'sitemap' OR published_at IS NOT NULL)),
known AS (SELECT source_id, external_id, h FROM hashed WHERE poll = 1),
once AS (SELECT * FROM hashed WHERE poll = 2 QUALIFY row_number() OVER (PARTITION BY source_id, external_id ORDER BY page_id) = 1),
uniq AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY h ORDER BY page_id) = 1),
admitted AS (SELECT *, CASE WHEN (source_id, external_id) IN (SELECT (source_id, external_id) FROM known) THEN 'update' ELSE 'insert' END AS action
  FROM uniq WHERE h NOT IN (SELECT h FROM known))"""


@query("d01_admission", B.with_(_CAND) + "SELECT page_id, source_id, external_id, h AS canonical_hash, action FROM admitted")
def d01(spark, sf):
    from newsgraph.functions import text as T, urls as U

    rows = candidate_rows(spark, sf)
    first = rows.filter("poll = 1").filter(U.is_news_candidate(c("url"))).filter(
        (c("source_kind") != "sitemap") | c("published_at").isNotNull()
    )
    known = first.withColumn("canonical_hash", T.canonical_hash(c("title"), c("url")))
    return DD.admit(rows.filter("poll = 2"), known, ["page_id"]).select(
        "page_id", "source_id", "external_id", "canonical_hash", "action"
    )


_URLS = f"""u AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') || CASE page_id % 3 WHEN 0 THEN '?utm_source=x' WHEN 1 THEN '/' ELSE '' END AS mention,
  to_timestamp(1704067200 + page_id * 9000)::TIMESTAMP AS t FROM pages),
keyed AS (SELECT *, {sql_key('url')} AS k, {sql_key('mention')} AS mk FROM u),
exact AS (SELECT url, min(page_id) AS id FROM keyed GROUP BY 1),
newest AS (SELECT k, arg_max(page_id, (t, -page_id)) AS id FROM keyed WHERE t >= (SELECT max(t) FROM u) - INTERVAL 30 DAY GROUP BY 1)"""


def mention_rows(spark, sf):
    i = c("page_id")
    tail = F.when(F.pmod(i, F.lit(3)) == 0, "?utm_source=x").when(F.pmod(i, F.lit(3)) == 1, "/").otherwise("")
    return table(spark, sf, "pages").select(
        i, "url", F.concat(F.regexp_replace("url", "[?#].*$", ""), tail).alias("mention"),
        F.timestamp_seconds(F.lit(1704067200) + i * 9000).alias("t"),
    )


@query(
    "d02_match_by_url",
    B.with_(_URLS) + "SELECT page_id, coalesce(e.id, n.id) AS matched_id FROM keyed LEFT JOIN exact e ON e.url = mention LEFT JOIN newest n ON n.k = mk",
)
def d02(spark, sf):
    rows = mention_rows(spark, sf)
    items = rows.select(c("page_id").alias("item_id"), "url", c("t").alias("published_at"), c("t").alias("fetched_at"))
    latest = F.lit(rows.agg(F.max("t")).first()[0])
    return DD.match_by_url(rows.select("page_id", c("mention").alias("url")), items, latest).select("page_id", "matched_id")


@query(
    "d03_fold_counters",
    """WITH m AS (SELECT event_id // 8 AS item_id, max(CAST(round(value) AS INTEGER)) FILTER (event_type = 'click') AS hn,
  max(CAST(round(value) AS INTEGER)) FILTER (event_type = 'view') AS rd FROM events WHERE event_type IN ('click', 'view') GROUP BY 1),
i AS (SELECT event_id // 8 AS item_id, min(CAST(round(value) AS INTEGER)) AS hn, CAST(NULL AS INTEGER) AS rd FROM events GROUP BY 1)
SELECT item_id, CASE WHEN coalesce(m.hn, 0) > coalesce(i.hn, 0) THEN m.hn ELSE i.hn END AS hn_points,
  CASE WHEN coalesce(m.rd, 0) > coalesce(i.rd, 0) THEN m.rd ELSE i.rd END AS reddit_upvotes FROM i LEFT JOIN m USING (item_id)""",
)
def d03(spark, sf):
    events = table(spark, sf, "events")
    points = F.round("value").cast("int")
    # Eight events make an item: the least of their points is its own count, clicks and views are its mentions.
    item = F.floor(c("event_id") / 8).cast("long").alias("item_id")
    items = events.groupBy(item).agg(F.min(points).alias("hn_points")).withColumn("reddit_upvotes", F.lit(None).cast("int"))
    mentions = events.filter(c("event_type").isin("click", "view")).select(
        item,
        F.when(c("event_type") == "click", points).alias("hn_points"),
        F.when(c("event_type") == "view", points).alias("reddit_upvotes"),
    )
    return DD.fold_counters(items, mentions, "item_id")


@query(
    "d04_one_cluster_per_article",
    "SELECT user_id AS article_id, arg_min(event_type, event_id) AS cluster_name, min(event_id) AS member_id FROM events GROUP BY user_id",
)
def d04(spark, sf):
    from newsgraph.operators.ranking import first_per_key

    rows = table(spark, sf, "events").select(c("user_id").alias("article_id"), c("event_type").alias("cluster_name"), c("event_id").alias("member_id"))
    return first_per_key(rows, ["article_id"], ["member_id"]).select("article_id", "cluster_name", "member_id")


@query(
    "d05_preference_upsert",
    """WITH o AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS min_show, c_custkey % 10 / 10.0 AS serendipity FROM customer WHERE c_custkey % 4 <> 0),
n AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 5 = 0 THEN 60.0 END AS min_show, CASE WHEN c_custkey % 7 = 0 THEN 0.3 END AS serendipity FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(n.min_show, o.min_show, 55.0) AS min_show, coalesce(n.serendipity, o.serendipity, 0.15) AS serendipity
FROM o FULL JOIN n USING (user_id)""",
)
def d05(spark, sf):
    k = c("c_custkey")
    base = table(spark, sf, "customer")
    old = base.filter(k % 4 != 0).select(
        k.alias("user_id"), F.when(k % 3 != 0, c("c_acctbal")).alias("min_show"), (k % 10 / 10.0).alias("serendipity")
    )
    new = base.filter(k % 2 == 0).select(
        k.alias("user_id"), F.when(k % 5 == 0, 60.0).alias("min_show"), F.when(k % 7 == 0, 0.3).alias("serendipity")
    )
    return DD.patch(old, new, ["user_id"], {"min_show": 55.0, "serendipity": 0.15})


@query(
    "d06_union_first_wins",
    """WITH l AS (SELECT user_id, event_id, 0 AS list_no, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS pos FROM events QUALIFY pos <= 30
 UNION ALL SELECT user_id, event_id, 1, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS p FROM events QUALIFY p <= 10)
SELECT user_id, event_id, list_no, pos FROM l QUALIFY row_number() OVER (PARTITION BY user_id, event_id ORDER BY list_no, pos) = 1""",
)
def d06(spark, sf):
    from newsgraph.operators.ranking import union_first_wins

    events = table(spark, sf, "events").select("user_id", "event_id", "value", "ts")
    a = top_per_group(events, ["user_id"], [F.desc("value"), F.asc("event_id")], 30, "pos").select("user_id", "event_id", "pos")
    b = top_per_group(events, ["user_id"], [F.desc("ts"), F.asc("event_id")], 10, "pos").select("user_id", "event_id", "pos")
    return union_first_wins([a, b], ["user_id"], "event_id", "pos")


@query(
    "d07_latest_snapshot",
    "SELECT arg_max(props, ts) AS canon_map, epoch_us(max(ts)) AS generated_us FROM events",
)
def d07(spark, sf):
    snaps = table(spark, sf, "events").select(c("props").alias("canon_map"), c("ts").alias("generated_at"))
    return DD.latest_snapshot(snaps, "canon_map", "generated_at").select("canon_map", F.unix_micros("generated_at").alias("generated_us"))


_RECENT = f"(fetched_at >= {NOW} - INTERVAL 72 HOUR OR created_at >= {NOW} - INTERVAL 72 HOUR)"


@query(
    "d08_rescore_recent",
    B.with_(B.ARTICLES, VERIFY, FINAL)
    + f"SELECT article_id, CASE WHEN {_RECENT} THEN blended ELSE final_score END AS final_score, {_RECENT} AS rescored FROM finals",
)
def d08(spark, sf):
    now = F.lit(as_of(spark, sf))
    cutoff = now - F.expr("INTERVAL 72 HOURS")
    articles = D.articles(spark, sf, text=False).select("article_id", "final_score", "fetched_at", "created_at")
    recent = (c("fetched_at") >= cutoff) | (c("created_at") >= cutoff)
    redone = finals(spark, sf).filter(recent).select("article_id", c("blended").alias("final_score"), F.lit(True).alias("rescored"))
    kept = articles.select("article_id", "final_score", F.lit(False).alias("rescored"))
    return DD.upsert(kept, redone, ["article_id"])


@query(
    "d09_verification_backfill",
    B.with_(B.ARTICLES, VERIFY)
    + f"SELECT article_id, state, label FROM labelled WHERE created_at >= {NOW} - INTERVAL 720 HOUR AND article_id % 3 = 0 ORDER BY created_at DESC, article_id LIMIT 200",
)
def d09(spark, sf):
    from newsgraph.catalog.scores import verified
    from newsgraph.operators.backfill import backfill_verification

    now = F.lit(as_of(spark, sf))
    rows = verified(spark, sf).withColumn("stored_state", F.when(mod("article_id", 3) != 0, "single_source_report"))
    return backfill_verification(rows, now, hours=720, batch=200).select("article_id", "state", "label")


@query(
    "d10_reclassify",
    B.with_(B.ARTICLES, B.TOPIC_ROWS)
    + """, top AS (SELECT article_id, max(weight) AS w FROM topic_rows GROUP BY 1)
SELECT a.article_id, CASE WHEN hit THEN 'PRODUCT_LAUNCH' ELSE event_type END AS event_type, hit AS reclassified FROM (
 SELECT a.*, coalesce((event_type = 'OTHER' OR coalesce(w, 0) < 0.35) AND (global_score >= 60) AND l.quality IS NOT NULL, false) AS hit
 FROM articles a LEFT JOIN top USING (article_id) LEFT JOIN labels l ON l.doc_id = a.article_id) a""",
)
def d10(spark, sf):
    labels = table(spark, sf, "labels").select(
        c("doc_id").alias("article_id"), F.lit("PRODUCT_LAUNCH").alias("event_type"),
        F.create_map(F.lit("llms"), F.lit(1.0)).alias("topics"),
    )
    rows = D.articles(spark, sf, text=False).withColumn("decision", F.lit("fetch_full"))
    return DD.take_labels(rows, labels).select("article_id", "event_type", "reclassified")


# --- aggregates -------------------------------------------------------------------------------


@query(
    "a01_cluster_stats",
    B.with_(B.ARTICLES, CLUSTER)
    + "SELECT s.cluster_id, coverage, sources, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us, top_article, top_score, md5(title) AS headline_md5 FROM cstats s JOIN articles a ON a.article_id = top_article",
)
def a01(spark, sf):
    return AG.cluster_stats(D.articles(spark, sf, text="title")).select(
        "cluster_id", c("coverage_count").alias("coverage"), c("sources_count").alias("sources"),
        F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"),
        c("top_article_id").alias("top_article"), c("max_score").alias("top_score"), F.md5("headline").alias("headline_md5"),
    )


WIRE = "The agency text that many papers print word for word on the day that it arrives, with nothing but a number of their own added at the end: "
_INDEP = f"""facts AS (SELECT cluster_id, regexp_replace({B.host('final_url')}, '^www\\.', '') AS host,
  lower(nullif(regexp_extract(substr(text, 1, 1000), {B.q('(?i)' + K.ATTRIBUTION_CHAINS[0])}, 1), '')) AS a1,
  lower(nullif(regexp_extract(substr(text, 1, 1000), {B.q('(?i)' + K.ATTRIBUTION_CHAINS[1])}, 1), '')) AS a2 FROM members),
agg AS (SELECT cluster_id, count(*) AS n, count(DISTINCT host) FILTER (host <> '') AS hosts FROM facts GROUP BY 1),
texts AS (SELECT cluster_id, article_id, list_distinct(list_transform(range(1, greatest(length(substr(text, 1, 500)) - 3, 1) + 1), lambda i: substr(text, i, 4))) AS s FROM members WHERE text <> ''),
opened AS (SELECT cluster_id, min(article_id) AS first_id, count(*) AS texts FROM texts GROUP BY 1),
echo AS (SELECT o.cluster_id, any_value(o.texts) AS texts, count(*) FILTER (2.0 * len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s)) > 0.6) AS echoes
  FROM opened o JOIN texts a ON a.cluster_id = o.cluster_id AND a.article_id = o.first_id JOIN texts b ON b.cluster_id = o.cluster_id AND b.article_id <> o.first_id GROUP BY 1),
named AS (SELECT cluster_id, count(DISTINCT a) AS named FROM (SELECT cluster_id, a1 AS a FROM facts UNION ALL SELECT cluster_id, a2 FROM facts) WHERE a IS NOT NULL GROUP BY 1)"""


@query(
    "a02_independent_sources",
    B.with_(
        B.ARTICLES.replace("articles AS (", "all_articles AS (", 1),
        f"articles AS (SELECT * REPLACE (coalesce(cluster_id, -1 - article_id % 7) AS cluster_id, CASE WHEN cluster_id IS NULL THEN {B.q(WIRE)} || article_id ELSE text END AS text) FROM all_articles)",
        CLUSTER, _INDEP,
        "counted AS (SELECT g.*, CASE WHEN texts >= 2 AND echoes > texts * 0.6 THEN greatest(1, hosts // 2) ELSE hosts END AS kept FROM agg g LEFT JOIN echo USING (cluster_id))",
    )
    + "SELECT g.cluster_id, CASE WHEN coalesce(named, 0) = 1 THEN greatest(1, kept - n // 2) ELSE kept END AS independent FROM counted g LEFT JOIN named USING (cluster_id)",
)
def a02(spark, sf):
    return independent_sources(_with_wires(spark, sf), blocks=False).select("cluster_id", "independent")


@query("a02_block_sources")
def a02_blocks(spark, sf):
    return independent_sources(_with_wires(spark, sf)).select("cluster_id", "independent")


def _with_wires(spark, sf):
    """Articles without a cluster become seven clusters of one wire text, so that echoes occur."""
    alone = c("cluster_id").isNull()
    rows = D.articles(spark, sf).withColumn("text", F.when(alone, F.concat(F.lit(WIRE), c("article_id").cast("string"))).otherwise(c("text")))
    return rows.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1) - F.pmod("article_id", F.lit(7))))


DOM_TOPIC = """tsum AS (SELECT cluster_id, topic, sum(weight) AS w FROM members JOIN topic_rows USING (article_id) GROUP BY ALL),
tn AS (SELECT cluster_id, count(*) FILTER (article_id % 11 <> 0) AS n FROM members GROUP BY 1),
tmean AS (SELECT cluster_id, topic, w / n AS mean FROM tsum JOIN tn USING (cluster_id)),
ttop AS (SELECT cluster_id, CASE WHEN round(mean, 9) >= 0.25 THEN topic ELSE 'mixed' END AS dominant_topic FROM tmean
  QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY round(mean, 9) DESC, topic) = 1),
dom_topic AS (SELECT tn.cluster_id, coalesce(dominant_topic, 'mixed') AS dominant_topic FROM tn LEFT JOIN ttop USING (cluster_id))"""
DOM_EVENT = """ecount AS (SELECT cluster_id, event_type, count(*) AS n FROM members GROUP BY ALL),
dom_event AS (SELECT cluster_id, CASE WHEN max(n) / sum(n) > 0.5 THEN arg_max(event_type, n) ELSE 'MIXED' END AS dominant_event_type FROM ecount GROUP BY 1)"""
DOM_ENTS = """ebest AS (SELECT cluster_id, entity, max(weight) AS weight FROM members JOIN entity_rows USING (article_id) GROUP BY ALL),
cents AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, entity) AS pos FROM ebest QUALIFY pos <= 5)"""


@query("a03_dominant_topic", B.with_(B.ARTICLES, B.TOPIC_ROWS, CLUSTER, DOM_TOPIC) + "SELECT cluster_id, dominant_topic FROM dom_topic")
def a03(spark, sf):
    return AG.dominant_topic(D.articles(spark, sf, text=False)).select("cluster_id", "dominant_topic")


@query("a04_dominant_event_type", B.with_(B.ARTICLES, CLUSTER, DOM_EVENT) + "SELECT cluster_id, dominant_event_type FROM dom_event")
def a04(spark, sf):
    rows = D.articles(spark, sf, text=False).filter(c("cluster_id").isNotNull())
    return AG.dominant_event_type(rows, "cluster_id", "event_type")


@query(
    "a05_cluster_entities",
    B.with_(B.ARTICLES, B.ENTITY_ROWS, CLUSTER, DOM_ENTS)
    + f"SELECT cluster_id, entity AS name, weight, pos, {B.lookup(K.ENTITY_TIERS, 'entity')} AS tier FROM cents",
)
def a05(spark, sf):
    return AG.cluster_entities(D.articles(spark, sf, text=False)).select("cluster_id", "name", "weight", "pos", "tier")


VELOCITY = f"""vel AS (SELECT *, coalesce({B.hours('first_seen', 'last_seen')}, 0.0) AS age_hours,
  coverage / greatest(coalesce({B.hours('first_seen', 'last_seen')}, 0.0), 0.1) AS velocity FROM cstats),
vrank AS (SELECT *, velocity >= 1.0 AND row_number() OVER (ORDER BY velocity DESC, cluster_id) <= 5 AS pulsing FROM vel)"""


@query(
    "a06_velocity",
    f"""WITH s AS (SELECT user_id, count(*) AS n, {B.hours('min(ts)', 'max(ts)')} AS h FROM events GROUP BY 1), v AS (SELECT user_id, n / greatest(h, 0.1) AS velocity FROM s)
SELECT user_id, round(velocity, 6) AS velocity, velocity >= 1.0 AND row_number() OVER (ORDER BY velocity DESC, user_id) <= 5 AS pulsing FROM v""",
)
def a06(spark, sf):
    stats = table(spark, sf, "events").groupBy(c("user_id").alias("cluster_id")).agg(
        F.count("*").alias("coverage_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )
    return AG.with_velocity(stats).select(c("cluster_id").alias("user_id"), F.round("velocity", 6).alias("velocity"), "pulsing")


@query(
    "a07_sparkline",
    "SELECT user_id, " + " || ',' || ".join(
        f"count(*) FILTER (date_diff('day', ts::DATE, {NOW}::DATE) = {6 - d})" for d in range(7)
    ) + " AS sparkline FROM events GROUP BY user_id",
)
def a07(spark, sf):
    line = AG.sparkline(table(spark, sf, "events"), "user_id", "ts", F.lit(as_of(spark, sf)))
    return line.select("user_id", F.array_join(c("sparkline").cast("array<string>"), ",").alias("sparkline"))


@query(
    "a08_topic_trends",
    B.with_(B.ARTICLES, B.TOPIC_ROWS)
    + f""", dated AS (SELECT topic, weight, date_diff('day', coalesce(published_at, fetched_at)::DATE, {NOW}::DATE) AS back FROM articles JOIN topic_rows USING (article_id)
 WHERE coalesce(published_at, fetched_at) >= {NOW} - INTERVAL 7 DAY)
SELECT topic, """ + ", ".join(f"round_even(coalesce(sum(weight) FILTER (back = {6 - d}), 0), 2) AS day{d}" for d in range(7))
    + f", round_even(coalesce(sum(weight) FILTER (back BETWEEN 0 AND 6), 0), 2) AS total FROM (SELECT unnest({B.arr(K.TOPICS)}) AS topic) LEFT JOIN dated USING (topic) GROUP BY topic",
)
def a08(spark, sf):
    return AG.topic_trends(D.articles(spark, sf, text=False), F.lit(as_of(spark, sf))).drop("label")


@query(
    "a09_cluster_trust",
    B.with_(B.ARTICLES, CLUSTER)
    + f""", base AS (SELECT s.cluster_id, sources, CASE WHEN s.cluster_id % 4 = 0 THEN (s.cluster_id % 100)::DOUBLE END AS stored, trust_score, trust_label,
 {B.hours('first_seen', NOW)} AS age, least(100.0, trust_score + CASE WHEN sources >= 3 THEN 10 ELSE 0 END) AS boosted FROM cstats s JOIN articles a ON a.article_id = top_article)
SELECT cluster_id, round(coalesce(stored, boosted), 6) AS trust, CASE WHEN stored IS NOT NULL THEN trust_label WHEN trust_label IN ('disputed', 'official') THEN trust_label
 WHEN boosted >= 75 AND sources >= 3 THEN 'confirmed' WHEN boosted >= 55 AND sources >= 2 THEN 'likely' WHEN coalesce(age, 0) < 6 THEN 'developing'
 WHEN boosted < 40 THEN 'unverified' ELSE trust_label END AS label FROM base""",
)
def a09(spark, sf):
    rows = D.articles(spark, sf, text=False)
    stats = AG.cluster_stats(rows)
    top = rows.select(c("article_id").alias("top_article_id"), "trust_score", "trust_label")
    stored = F.when(mod("cluster_id", 4) == 0, mod("cluster_id", 100).cast("double"))
    age = S.hours_between(c("first_seen"), F.lit(as_of(spark, sf)))
    view = TR.cluster_trust(stored, F.lit(None).cast("string"), c("trust_score"), c("trust_label"), c("sources_count"), age)
    return stats.join(top, "top_article_id").select("cluster_id", view.alias("t")).select(
        "cluster_id", F.round("t.trust", 6).alias("trust"), "t.label"
    )


_LOG = """log AS (SELECT '/p/' || (user_id % 30) AS path, CAST(round(value * 100) AS BIGINT) AS response_bytes, event_id % 977 AS dependency_bytes,
 CAST(event_type = 'click' AS INTEGER) AS cache_hits, CAST(event_type = 'error' AS INTEGER) AS cache_misses, CAST(event_type = 'view' AS INTEGER) AS cache_sets, value AS duration_ms FROM events),
roll AS (SELECT path, count(*) AS requests, sum(response_bytes) AS response_bytes, sum(dependency_bytes) AS dependency_bytes, sum(cache_hits) AS cache_hits,
 sum(cache_misses) AS cache_misses, sum(cache_sets) AS cache_sets, round_even(sum(response_bytes) / count(*), 2) AS avg_response_bytes,
 round_even(sum(duration_ms) / count(*), 2) AS avg_duration_ms FROM log GROUP BY 1)"""


def request_log(spark, sf):
    is_ = lambda name: (c("event_type") == name).cast("int")
    return table(spark, sf, "events").select(
        F.concat(F.lit("/p/"), mod("user_id", 30).cast("string")).alias("path"),
        F.round(c("value") * 100).cast("long").alias("response_bytes"), mod("event_id", 977).alias("dependency_bytes"),
        is_("click").alias("cache_hits"), is_("error").alias("cache_misses"), is_("view").alias("cache_sets"),
        c("value").alias("duration_ms"), "ts",
        F.array(
            F.struct(c("event_type").alias("service"), F.concat(F.lit("t"), mod("user_id", 9).cast("string")).alias("target"), mod("event_id", 977).alias("bytes"))
        ).alias("dependency_targets"),
    )


@query("a10_request_rollup", B.with_(_LOG) + "SELECT * FROM roll ORDER BY response_bytes + dependency_bytes DESC, requests DESC, path LIMIT 20")
def a10(spark, sf):
    return LG.request_rollup(request_log(spark, sf))


@query(
    "a10_dependency_targets",
    "SELECT event_type AS service, 't' || (user_id % 9) AS target, sum(event_id % 977) AS bytes FROM events GROUP BY ALL ORDER BY bytes DESC, service, target LIMIT 20",
)
def a10_targets(spark, sf):
    return LG.dependency_targets(request_log(spark, sf))


_QLOG = f"""ql AS (SELECT {_SHAPE.format(s=_STATEMENT)} AS sql_fingerprint, event_type AS caller, user_id AS row_count, CAST(round(value * 1000) AS BIGINT) AS estimated_bytes, value AS duration_ms FROM events)"""
_HUMAN = "CASE WHEN {b} < 1024 THEN printf('%.1f B', {b}::DOUBLE) WHEN {b} < 1048576 THEN printf('%.1f KB', {b} / 1024) WHEN {b} < 1073741824 THEN printf('%.1f MB', {b} / 1048576) ELSE printf('%.1f GB', {b} / 1073741824) END"


def query_log(spark, sf):
    shape = CD.sql_fingerprint(c("sql_text"))
    return statements(spark, sf).select(
        shape.alias("sql_fingerprint"), F.substring(F.md5(shape), 1, 12).alias("sql_hash"), c("event_type").alias("caller"),
        c("user_id").alias("row_count"), F.round(c("value") * 1000).cast("long").alias("estimated_bytes"), c("value").alias("duration_ms"), "ts",
    )


@query(
    "a11_query_rollup",
    B.with_(_QLOG) + f"""SELECT substr(md5(sql_fingerprint), 1, 12) AS sql_hash, sql_fingerprint, count(*) AS queries, sum(estimated_bytes) AS total_bytes, sum(row_count) AS total_rows,
 string_agg(DISTINCT caller, ',' ORDER BY caller) AS callers, CAST(round_even(sum(estimated_bytes) / count(*), 0) AS BIGINT) AS avg_bytes,
 round_even(sum(duration_ms) / count(*), 2) AS avg_duration_ms, {_HUMAN.format(b='sum(estimated_bytes)')} AS total_human FROM ql GROUP BY ALL ORDER BY total_bytes DESC LIMIT 30""",
)
def a11(spark, sf):
    return LG.query_rollup(query_log(spark, sf))


@query(
    "a11_caller_rollup",
    B.with_(_QLOG) + "SELECT caller, count(*) AS queries, sum(estimated_bytes) AS total_bytes, sum(row_count) AS total_rows, count(DISTINCT sql_fingerprint) AS statements FROM ql GROUP BY ALL ORDER BY total_bytes DESC LIMIT 30",
)
def a11_callers(spark, sf):
    return LG.caller_rollup(query_log(spark, sf))


@query(
    "a12_size_estimate",
    """WITH r AS (SELECT source, strlen(text) AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, n AS row_count, CAST(floor(sum(b) / count(*) * n) AS BIGINT) AS estimated_bytes FROM r WHERE rn <= 10 GROUP BY source, n""",
)
def a12(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", F.octet_length("text").alias("size"))
    return LG.size_estimate(docs, ["source"], ["doc_id"], "size")


@query(
    "a13_recent_entities",
    B.with_(B.ARTICLES, B.ENTITY_ROWS) + f"SELECT DISTINCT entity FROM entity_rows JOIN articles USING (article_id) WHERE created_at >= {NOW} - INTERVAL 7 DAY",
)
def a13(spark, sf):
    cutoff = F.lit(as_of(spark, sf)) - F.expr("INTERVAL 7 DAYS")
    rows = D.articles(spark, sf, text=False).filter(c("created_at") >= cutoff)
    return rows.select(F.explode(F.map_keys("entities")).alias("entity")).distinct()


@query(
    "a14_group_by_content_type",
    B.with_(B.ARTICLES)
    + """, t AS (SELECT 'all' AS tab, * FROM articles UNION ALL SELECT content_type, * FROM articles),
k AS (SELECT source_name, tab, article_id, row_number() OVER (PARTITION BY source_name, tab ORDER BY global_score DESC, article_id) AS rn FROM t QUALIFY rn <= 30)
SELECT source_name, tab, string_agg(article_id::VARCHAR, ',' ORDER BY rn) AS ids FROM k GROUP BY ALL""",
)
def a14(spark, sf):
    from newsgraph.operators.selection import tabs_of

    rows = D.articles(spark, sf, text=False).select("source_name", "content_type", "article_id", "global_score")
    return tabs_of(rows, ["source_name"], [F.desc("global_score"), F.asc("article_id")], "article_id", 30)


@query(
    "a15_hide_sample_feed",
    "SELECT source, count(*) AS n FROM documents WHERE source <> 'src0' OR NOT EXISTS (SELECT 1 FROM documents WHERE source <> 'src0') GROUP BY 1",
)
def a15(spark, sf):
    from newsgraph.operators.selection import hide_sample

    docs = table(spark, sf, "documents").select("source")
    return hide_sample(docs, "source", "src0").groupBy("source").agg(F.count("*").alias("n"))


@query(
    "a16_sitemap_coverage",
    f"""SELECT {B.host('url')} AS host, count(*) AS total, count(*) FILTER (contains(url, '/en/')) AS matching, count(*) FILTER (contains(url, '/en/')) > 0 AS passed FROM pages GROUP BY 1""",
)
def a16(spark, sf):
    from newsgraph.functions import urls as U

    return (
        table(spark, sf, "pages")
        .groupBy(U.host(c("url")).alias("host"))
        .agg(F.count("*").alias("total"), F.count_if(F.contains(c("url"), F.lit("/en/"))).alias("matching"))
        .withColumn("passed", c("matching") > 0)
    )
