"""S, T and E rows: landed feeds, sinks, streaming forms and evaluation reports."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from newsgraph.catalog import sqlbase as B
from newsgraph.catalog.scalars import _PLAIN, sql_evergreen, sql_ws  # noqa: F401
from newsgraph.catalog.scores import CLUSTER, NOW
from newsgraph.catalog.sets import _LOG, request_log
from newsgraph.functions import scoring as S
from newsgraph.operators import aggregates as AG, evaluate as EV, logs as LG, ranking as R
from newsgraph.operators.dedup import upsert
from newsgraph.session import shared_folder
from newsgraph.sources import feed_log as FL, landing as L, sinks as SK, standin as D
from newsgraph.sources.tables import as_of, table
from newsgraph.sources.versioned import VersionedTable
from newsgraph.streaming import keyed, streams as ST

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


now_of = lambda spark, sf: F.lit(as_of(spark, sf))
A = B.with_(B.ARTICLES)
s = lambda name: c(name).cast("string")


@query("s01_column_scan", "SELECT source, lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY ALL")
def s01(spark, sf):
    # The text column is never read.
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


# --- landed feeds -----------------------------------------------------------------------------


def feed_rows(spark, sf):
    iso = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = D.articles(spark, sf)
    return rows.select(
        "article_id", "title", F.concat(F.lit(" x  "), c("title"), F.lit("\n y")).alias("body"), c("final_url").alias("url"), "source_name",
        iso(c("published_at")).alias("at"), F.pmod("article_id", F.lit(500)).cast("int").alias("points"), F.unix_seconds("published_at").cast("double").alias("epoch"),
    )


def payloads_of(rows, wrapper: str, item):
    """Every item lands twice, in two payloads."""
    doc = F.to_json(F.struct(F.array(item).alias(wrapper)))
    numbers = F.array(c("article_id"), c("article_id") + 1_000_000_000)
    return rows.select(numbers.alias("numbers"), doc.alias("payload")).select(F.explode("numbers").alias("payload_no"), "payload")


def shown(df):
    return df.select(
        "external_id", "url", F.md5("title").alias("title_md5"), F.md5(F.coalesce("snippet", F.lit(""))).alias("snippet_md5"), "author",
        F.unix_seconds("published_at").alias("published"), "hn_points", "hn_comments", "reddit_upvotes", "github_stars",
    )


_SEC = "CAST(floor(epoch_us(published_at) / 1e6) AS BIGINT)"


def sql_feed(ext: str, url: str, title: str, snippet: str, author: str, hours: int | None, default_now: bool = False, published: str = _SEC, **counters) -> str:
    when = f"coalesce({published}, CAST(floor(epoch_us({NOW}) / 1e6) AS BIGINT))" if default_now else published
    keep = "true" if hours is None else f"({published} IS NULL OR {published} >= epoch_us({NOW}) / 1e6 - {hours * 3600})"
    cols = ", ".join(f"{counters.get(n, 'CAST(NULL AS BIGINT)')} AS {n}" for n in ("hn_points", "hn_comments", "reddit_upvotes", "github_stars"))
    return A + (
        f"SELECT {ext} AS external_id, {url} AS url, md5({title}) AS title_md5, md5({snippet}) AS snippet_md5, {author} AS author, {when} AS published, {cols} "
        f"FROM articles WHERE {keep}"
    )


_T = sql_ws("title")
_BODY = sql_ws("' x  ' || title || chr(10) || ' y'")
_P = "article_id % 500"
_SAFE = "regexp_replace(title, '[^A-Za-z0-9 ]', '', 'g')"


def xml_rows(spark, sf):
    rows = feed_rows(spark, sf)
    return rows.withColumn("safe", F.regexp_replace("title", "[^A-Za-z0-9 ]", "")).withColumn("url", F.regexp_replace("url", "&", "&amp;"))


@query("s02_rss_items", sql_feed("CASE WHEN article_id % 2 = 0 THEN 'g' || article_id ELSE final_url END", "final_url", sql_ws(_SAFE), f"'b ' || {sql_ws(_SAFE)}", "source_name", 168))
def s02(spark, sf):
    t = lambda tag, x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))
    rows = xml_rows(spark, sf)
    i = c("article_id")
    item = F.concat(
        F.when(i % 2 == 0, t("guid", F.concat(F.lit("g"), i.cast("string")))).otherwise(""), t("link", c("url")), t("title", c("safe")),
        t("description", F.concat(F.lit("&lt;b&gt;b&lt;/b&gt; "), c("safe"))), t("author", c("source_name")),
        F.when(c("at").isNotNull(), F.when(i % 3 == 0, t("updated", c("at"))).otherwise(t("pubDate", c("at")))).otherwise(""),
    )
    feed = F.concat(F.lit("<rss><channel>"), t("item", item), t("item", item), F.lit("</channel></rss>"))
    payloads = rows.select(i.alias("payload_no"), feed.alias("payload"))
    return shown(L.candidates(payloads, "rss", now_of(spark, sf)))


@query("s03_arxiv_items", sql_feed("final_url", "final_url", sql_ws(_SAFE), sql_ws(_SAFE), "source_name", 72))
def s03(spark, sf):
    t = lambda tag, x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))
    rows = xml_rows(spark, sf)
    entry = F.concat(
        t("id", c("url")), t("title", c("safe")), t("summary", c("safe")), F.when(c("at").isNotNull(), t("updated", c("at"))).otherwise(""),
        F.lit("<author>"), t("name", c("source_name")), F.lit("</author>"),
    )
    payloads = rows.select(c("article_id").alias("payload_no"), F.concat(F.lit("<feed>"), t("entry", entry), t("entry", entry), F.lit("</feed>")).alias("payload"))
    return shown(L.candidates(payloads, "atom", now_of(spark, sf), 72))


_SLUG = "regexp_extract(regexp_replace(" + B.path("url") + ", '/+$', ''), '([^/]*)$', 1)"


@query(
    "s04_sitemap_urls",
    f"SELECT url AS external_id, {_SLUG} AS title, CASE WHEN page_id % 4 <> 0 THEN 1704067200 + page_id * 3600 END AS published FROM pages WHERE NOT {sql_evergreen('url')} "
    f"AND CASE WHEN page_id % 4 <> 0 THEN 1704067200 + page_id * 3600 >= epoch_us({NOW}) / 1e6 - 168 * 3600 ELSE true END QUALIFY page_id % 4 <> 0 OR row_number() OVER (PARTITION BY page_id % 4 <> 0, page_id % 5 ORDER BY page_id) <= 200",
)
def s04(spark, sf):
    i = c("page_id")
    lastmod = F.date_format(F.timestamp_seconds(F.lit(1704067200) + i * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    entry = F.concat(
        F.lit("<urlset><url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc>"),
        F.when(i % 4 != 0, F.concat(F.lit("<lastmod>"), lastmod, F.lit("</lastmod>"))).otherwise(""), F.lit("</url><url/></urlset>"),
    )
    payloads = table(spark, sf, "pages").select(F.concat(F.lit("s"), (i % 5).cast("string")).alias("source_name"), i.alias("payload_no"), entry.alias("payload"))
    found = L.sitemap_candidates(payloads, now_of(spark, sf), lastmod_optional=True)
    # Slugs of the pages are numbers, so titles read like the slug.
    return found.select("external_id", F.regexp_replace("title", r"\.Html$", ".html").alias("title"), F.unix_seconds("published_at").alias("published"))


_HN = sql_feed("'h' || article_id", "final_url", _T, _BODY, "source_name", 168, hn_points=_P, hn_comments="(article_id % 500) // 2")


def hn_payloads(spark, sf):
    none = F.lit(None).cast("string")
    odd = c("article_id") % 2 == 1
    item = F.struct(
        F.concat(F.lit("h"), s("article_id")).alias("objectID"), "title", F.when(odd, c("url")).otherwise(none).alias("url"), F.when(~odd, c("url")).alias("story_url"),
        c("body").alias("story_text"), c("source_name").alias("author"), c("at").alias("created_at"), "points", F.floor(c("points") / 2).cast("int").alias("num_comments"),
    )
    return payloads_of(feed_rows(spark, sf), "hits", item)


@query("s05_hackernews_items", _HN)
def s05(spark, sf):
    return shown(L.candidates(hn_payloads(spark, sf), "hn", now_of(spark, sf)))


_REDDIT = sql_feed("'r' || article_id", "final_url", _T, _BODY, "source_name", 24, reddit_upvotes=_P)


def reddit_payloads(spark, sf):
    item = F.struct(
        F.concat(F.lit("r"), s("article_id")).alias("id"), "url", "title", c("body").alias("selftext"), c("source_name").alias("author"), c("epoch").alias("created_utc"), c("points").alias("score")
    )
    return payloads_of(feed_rows(spark, sf), "data", item)


@query("s06_reddit_items", _REDDIT)
def s06(spark, sf):
    return shown(L.candidates(reddit_payloads(spark, sf), "reddit", now_of(spark, sf)))


_LOGGED = f"SELECT 'hn' AS feed, * FROM ({_HN}) UNION ALL SELECT 'reddit', * FROM ({_REDDIT})"
LOGGED_FEEDS = {"hn": hn_payloads, "reddit": reddit_payloads}


def logged(spark, sf):
    """Payloads of two feeds as a fetcher logs them: (feed, payload_no, payload)."""
    return reduce(DataFrame.unionByName, [make(spark, sf).withColumn("feed", F.lit(feed)) for feed, make in LOGGED_FEEDS.items()])


@query("s05_feed_log", _LOGGED)
def s05_log(spark, sf):
    """Candidates of two feeds out of a landing log, read by the data source."""
    folder = f"{shared_folder(spark)}/logs/{uuid.uuid4().hex}"
    FL.land(logged(spark, sf), folder)
    log, now = FL.read_log(spark, folder), now_of(spark, sf)
    found = [shown(L.candidates(FL.payloads_of(log, feed), feed, now)).withColumn("feed", F.lit(feed)) for feed in LOGGED_FEEDS]
    return reduce(DataFrame.unionByName, found)


@query(
    "s07_github_repos",
    A + """, hits AS (SELECT article_id % 5 AS run, article_id // 20 AS term, article_id, 'repo' || (article_id % 700) AS id FROM articles),
 once AS (SELECT run, id, min(term) AS term FROM hits GROUP BY ALL), per AS (SELECT run, term, count(*) AS n FROM once GROUP BY ALL),
 ok AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY run ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per)
SELECT run, id AS external_id FROM once JOIN ok USING (run, term) WHERE before < 60""",
)
def s07(spark, sf):
    i = c("article_id")
    item = F.struct(
        F.concat(F.lit("repo"), (i % 700).cast("string")).alias("id"), c("title").alias("full_name"), c("url").alias("html_url"), c("body").alias("description"),
        F.struct(c("source_name").alias("login")).alias("owner"), c("points").alias("stargazers_count"),
    )
    payloads = feed_rows(spark, sf).select((i % 5).alias("run"), F.floor(i / 20).alias("payload_no"), F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"))
    return L.github_candidates(payloads, now_of(spark, sf)).select("run", "external_id")


@query(
    "s08_github_trending",
    f"""WITH p AS (SELECT page_id, 'org' || page_id || '/tool' AS path, {B.pick(['a small llm server', 'recipes for bread', 'vector embedding store', 'a font', 'plain notes'], 'page_id')} AS d FROM pages)
SELECT page_id, path AS external_id, path || ': ' || d AS title, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1000 + page_id END AS github_stars FROM p WHERE regexp_matches(lower(path || ' ' || d), {B.q('(?:' + '|'.join(L.TRENDING_WORDS) + ')')})""",
)
def s08(spark, sf):
    i = c("page_id")
    text = D.pick(["a small llm server", "recipes for bread", "vector embedding store", "a font", "plain notes"], i)
    stars = F.when(i % 3 == 0, "many").otherwise(F.format_number(1000 + i, 0))
    block = F.concat(
        F.lit('<article class="Box-row"><h2><a class="x" href="/org'), i.cast("string"), F.lit('/tool">t</a></h2><p> '), text,
        F.lit(' </p><a class="stargazers"> '), stars, F.lit("</a></article>"),
    )
    pages = table(spark, sf, "pages").select("page_id", F.concat("html", block).alias("html"))
    return L.trending_candidates(pages, "html", now_of(spark, sf)).select("page_id", "external_id", "title", "github_stars")


_CUT = lambda x: f"substr({x}, 1, 140)"


@query("s09_bluesky_posts", sql_feed("'at://p/' || article_id", "'https://bsky.app/profile/' || source_name || '/post/' || article_id", _CUT(_BODY), _BODY, "source_name", 24, True, reddit_upvotes=_P))
def s09(spark, sf):
    item = F.struct(
        F.concat(F.lit("at://p/"), s("article_id")).alias("uri"), F.struct(c("body").alias("text"), c("at").alias("createdAt")).alias("record"),
        F.struct(c("source_name").alias("handle")).alias("author"), c("points").alias("likeCount"),
    )
    return shown(L.candidates(payloads_of(feed_rows(spark, sf), "posts", item), "bluesky", now_of(spark, sf)))


@query("s10_mastodon_posts", sql_feed("CAST(article_id AS VARCHAR)", "final_url", _CUT(sql_ws(_SAFE)), sql_ws(_SAFE), "source_name", 24, True, reddit_upvotes=_P))
def s10(spark, sf):
    item = F.struct(
        s("article_id").alias("id"), F.concat(F.lit("<p>"), F.regexp_replace("title", "[^A-Za-z0-9 ]", ""), F.lit("</p>")).alias("content"), c("at").alias("created_at"),
        c("url").alias("uri"), F.struct(F.lit("").alias("acct"), c("source_name").alias("username")).alias("account"), c("points").alias("favourites_count"),
    )
    return shown(L.candidates(payloads_of(feed_rows(spark, sf), "posts", item), "mastodon", now_of(spark, sf)))


@query("s11_twitter_posts", sql_feed("CAST(article_id AS VARCHAR)", "'https://x.com/' || source_name || '/status/' || article_id", _CUT(_BODY), _BODY, "source_name", 24, True, reddit_upvotes=_P))
def s11(spark, sf):
    item = F.struct(
        s("article_id").alias("id"), c("body").alias("rawContent"), c("at").alias("date"), F.struct(c("source_name").alias("username")).alias("user"), c("points").alias("likeCount")
    )
    return shown(L.candidates(payloads_of(feed_rows(spark, sf), "tweets", item), "twitter", now_of(spark, sf)))


@query(
    "s12_hf_papers",
    sql_feed("'hf:' || article_id", "'https://arxiv.org/abs/' || article_id", _T, f"CASE WHEN article_id % 2 = 0 THEN 'short' ELSE {_BODY} END", "'A1, A2, A3, A4, A5'", 48,
             hn_points=_P, github_stars="CASE WHEN article_id % 3 = 0 THEN article_id % 500 END"),
)
def s12(spark, sf):
    i = c("article_id")
    names = F.array(*[F.struct(F.lit(f"A{n}").alias("name")) for n in range(1, 8)])
    item = F.struct(F.struct(
        s("article_id").alias("id"), "title", c("body").alias("summary"), F.when(i % 2 == 0, "short").alias("ai_summary"), c("at").alias("publishedAt"), names.alias("authors"),
        c("points").alias("upvotes"), F.when(i % 3 == 0, "x/y").alias("githubRepo"), c("points").alias("githubStars"),
    ).alias("paper"))
    return shown(L.candidates(payloads_of(feed_rows(spark, sf), "papers", item), "hf_papers", now_of(spark, sf)))


@query(
    "s13_semantic_scholar",
    sql_feed("'s2:' || article_id", "CASE WHEN article_id % 2 = 0 THEN 'https://pdf/' || article_id ELSE 'https://www.semanticscholar.org/paper/' || article_id END", _T, _BODY, "'A1, A2'", None,
             published="CAST(floor(epoch_us(date_trunc('day', published_at)) / 1e6) AS BIGINT)", hn_points=_P),
)
def s13(spark, sf):
    i = c("article_id")
    item = F.struct(
        s("article_id").alias("paperId"), "title", c("body").alias("abstract"), F.when(i % 2 == 0, F.struct(F.concat(F.lit("https://pdf/"), i.cast("string")).alias("url"))).alias("openAccessPdf"),
        F.substring("at", 1, 10).alias("publicationDate"), F.array(F.struct(F.lit("A1").alias("name")), F.struct(F.lit("A2").alias("name"))).alias("authors"), c("points").alias("citationCount"),
    )
    return shown(L.candidates(payloads_of(feed_rows(spark, sf), "data", item), "semantic_scholar", now_of(spark, sf)))


@query("s14_nvd_records", sql_feed("'CVE-2024-' || article_id", "'https://nvd.nist.gov/vuln/detail/CVE-2024-' || article_id", f"'CVE-2024-' || article_id || ': ' || {sql_ws('substr(title, 1, 200)')}", _T, "CAST(NULL AS VARCHAR)", 168))
def s14(spark, sf):
    texts = F.array(F.struct(F.lit("es").alias("lang"), F.lit("no").alias("value")), F.struct(F.lit("en").alias("lang"), c("title").alias("value")), F.struct(F.lit("en").alias("lang"), F.lit("later").alias("value")))
    item = F.struct(F.struct(F.concat(F.lit("CVE-2024-"), s("article_id")).alias("id"), c("at").alias("published"), texts.alias("descriptions")).alias("cve"))
    return shown(L.candidates(payloads_of(feed_rows(spark, sf), "vulnerabilities", item), "nvd", now_of(spark, sf)))


@query("s15_congress_bills", sql_feed("'https://bill/' || article_id", "'https://bill/' || article_id", _T, "''", "CAST(NULL AS VARCHAR)", 168, True))
def s15(spark, sf):
    item = F.struct(F.concat(F.lit("https://bill/"), s("article_id")).alias("url"), "title", c("at").alias("updateDate"))
    return shown(L.candidates(payloads_of(feed_rows(spark, sf), "bills", item), "congress", now_of(spark, sf)))


@query(
    "s16_source_catalogue",
    """SELECT source AS name, arg_max(CASE WHEN doc_id % 3 = 0 THEN 'sitemap' ELSE 'rss' END, doc_id) AS kind,
 arg_max(CASE WHEN doc_id % 3 = 0 THEN 'm' || doc_id ELSE 'f' || doc_id END, doc_id) AS feed_url, arg_max(CASE WHEN doc_id % 2 = 0 THEN (doc_id % 10) / 10.0 ELSE 0.5 END, doc_id) AS authority FROM documents GROUP BY 1""",
)
def s16(spark, sf):
    i = c("doc_id")
    none = F.lit(None)
    rows = table(spark, sf, "documents").select(
        c("source").alias("name"), i.alias("place"), F.when(i % 3 == 0, "sitemap").otherwise("rss").alias("kind"), none.cast("string").alias("base_url"), F.lit("/news").alias("path_filter"),
        F.when(i % 3 != 0, F.concat(F.lit("f"), i.cast("string"))).alias("feed_url"), F.concat(F.lit("m"), i.cast("string")).alias("sitemap_url"),
        F.when(i % 2 == 0, (i % 10) / 10.0).alias("authority"), none.cast("boolean").alias("always_scrape"), none.cast("boolean").alias("priority_poll"),
        none.cast("boolean").alias("enabled"), none.cast("double").alias("rate_limit_rps"),
    )
    return L.source_catalogue(rows).select("name", "kind", "feed_url", "authority")


# --- sinks ------------------------------------------------------------------------------------



def digest_rows(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(c("o_orderstatus").alias("user_id"), c("o_orderpriority").alias("content_type")).agg(
        F.count("*").alias("items"), F.max("o_orderkey").alias("top_id")
    ).withColumn("date", F.lit("2024-01-30"))


@query("s17_digest_artifacts", "SELECT o_orderstatus AS user_id, o_orderpriority AS content_type, count(*) AS items, max(o_orderkey) AS top_id FROM orders GROUP BY ALL")
def s17(spark, sf):
    folder = ST.work_folder(spark)
    SK.write_digests(digest_rows(spark, sf), folder)
    # A second run replaces its own partitions only.
    SK.write_digests(digest_rows(spark, sf).filter("user_id = 'F'"), folder)
    return SK.read_digests(spark, folder, "items bigint, top_id bigint, user_id string, date string, content_type string").drop("date")


@query(
    "s18_digest_upsert",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0",
)
def s18(spark, sf):
    o = table(spark, sf, "orders").select(c("o_orderkey").alias("id"))
    old = o.filter("id % 2 = 0").withColumn("version", F.lit("old"))
    return upsert(old, o.filter("id % 3 = 0").withColumn("version", F.lit("new")), ["id"])


@query(
    "s18_versioned_upsert",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0",
)
def s18_versioned(spark, sf):
    """The same upsert on a stored table: each writer adds a version, and a writer from an old version is refused."""
    stored = VersionedTable(spark, f"{shared_folder(spark)}/digests-{uuid.uuid4().hex}")
    o = table(spark, sf, "orders").select(c("o_orderkey").alias("id"))
    stored.upsert(o.filter("id % 2 = 0").withColumn("version", F.lit("old")), ["id"])
    stored.upsert(o.filter("id % 3 = 0").withColumn("version", F.lit("new")), ["id"])
    return stored.read()


@query("s19_query_log", "SELECT event_type AS caller, count(*) AS n, sum(user_id) AS row_count FROM events GROUP BY 1")
def s19(spark, sf):
    folder = ST.work_folder(spark)
    log = table(spark, sf, "events").select("event_id", c("event_type").alias("caller"), c("user_id").alias("row_count"))
    SK.append_log(log.filter("event_id % 2 = 0"), folder)
    SK.append_log(log.filter("event_id % 2 = 1"), folder)
    saved = spark.read.schema("event_id bigint, caller string, row_count bigint").json(folder)
    return saved.groupBy("caller").agg(F.count("*").alias("n"), F.sum("row_count").alias("row_count"))


@query(
    "s20_urgent_export",
    A + f"SELECT md5(title) AS title_md5, final_url AS url, source_name AS source, global_score FROM articles WHERE global_score >= 50 AND {B.hours('coalesce(published_at, fetched_at)', NOW)} <= 48",
)
def s20(spark, sf):
    rows = D.articles(spark, sf).withColumn("urgent", c("global_score") >= 50)
    return SK.urgent_export(rows, now_of(spark, sf), 48).select(F.md5("title").alias("title_md5"), "url", "source", "global_score")


# --- streaming --------------------------------------------------------------------------------


@query("t01_new_item_feed", f"SELECT event_id, round(value * pow(2.0, -{B.hours('ts', NOW)} / 18), 6) AS rank FROM events WHERE ts > {NOW} - INTERVAL 24 HOUR")
def t01(spark, sf):
    now = now_of(spark, sf)
    stream = ST.new_items(ST.read_landing(spark, sf, "events"), now - F.expr("INTERVAL 24 HOURS"))
    rank = S.feed_rank(c("value"), S.hours_between(c("ts"), now), F.lit(1.0), 18.0)
    return ST.drain_append(stream.select("event_id", F.round(rank, 6).alias("rank")), ST.work_folder(spark))


def _sql_stream_feed() -> str:
    from newsgraph.catalog import feeds as FE
    from newsgraph.catalog.scalars import _CATEGORY

    return FE.B.with_(*FE._LIVE, _CATEGORY, FE.sql_cards("editorial_rank", 18)) + (
        "SELECT article_id, title, category, shown_source, user_score, rank_score, shown_score FROM cand JOIN articles USING (article_id, title) WHERE user_score >= min_score")


@query("t01_article_stream", _sql_stream_feed())
def t01_stream(spark, sf):
    """Documents as they land, scored as the live feed scores them: evergreen filter, event time, reader score, threshold, category."""
    from newsgraph.catalog import feeds as FE
    from newsgraph.plans import feed as FD

    landed = ST.read_landing(spark, sf, "documents")
    rows = D.articles(spark, sf, text="title", docs=landed).withColumn("urgent", c("global_score") >= 60)
    items = FD.stream_items(rows, FE.cluster_view(spark, sf), FE.one_reader(spark), now_of(spark, sf))
    return ST.drain_append(items.select("article_id", "title", "category", "shown_source", "user_score", "rank_score", "shown_score"), ST.work_folder(spark))


@query("t01_feed_log", _LOGGED)
def t01_log(spark, sf):
    """Candidates of two feeds whose log is read as a stream: once when half of it has landed and, restarted, when all has."""
    folder = f"{shared_folder(spark)}/logs/{uuid.uuid4().hex}"
    rows, work = logged(spark, sf), ST.work_folder(spark)
    again = c("payload_no") >= 1_000_000_000
    for half in (~again, again):
        FL.land(rows.filter(half), folder)
        stored = ST.drain_append(FL.stream_log(spark, folder).select("feed", "payload_no", "payload"), work)
    now = now_of(spark, sf)
    found = [shown(L.candidates(FL.payloads_of(stored, feed), feed, now)).withColumn("feed", F.lit(feed)) for feed in LOGGED_FEEDS]
    return reduce(DataFrame.unionByName, found)


@query("t02_lateness", f"SELECT event_id, event_type FROM events WHERE ts >= {NOW} - INTERVAL 168 HOUR")
def t02(spark, sf):
    stream = ST.within_lateness(ST.read_landing(spark, sf, "events"), now_of(spark, sf))
    return ST.drain_append(stream.select("event_id", "event_type"), ST.work_folder(spark))


@query("t03_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def t03(spark, sf):
    stream = ST.first_sightings(ST.read_landing(spark, sf, "events"), ["user_id", "event_type"])
    return ST.drain_append(stream.select("user_id", "event_type"), ST.work_folder(spark))


@query("t04_running_maxima", "SELECT user_id, max(value) FILTER (event_type = 'click') AS clicks, max(value) FILTER (event_type = 'view') AS views FROM events GROUP BY 1")
def t04(spark, sf):
    pick = lambda name: F.when(c("event_type") == name, c("value"))
    stream = ST.running_maxima(ST.read_landing(spark, sf, "events"), "user_id", {"clicks": pick("click"), "views": pick("view")})
    return ST.drain_update(stream, ST.work_folder(spark), ["user_id"])


@query("t05_alert_once", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) IS NOT NULL AS sent FROM events WHERE value >= 100 GROUP BY 1")
def t05(spark, sf):
    stream = ST.read_landing(spark, sf, "events").withColumn("sent", F.lit(True))
    return ST.alert_once(stream, ST.work_folder(spark), "user_id", c("value") >= 100, ["user_id", "event_id", "sent"])


@query("t05_new_cluster_alerts", "SELECT user_id AS cluster_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def t05_new(spark, sf):
    """A cluster is announced with its first item (coverage 1), once."""
    stream = ST.read_landing(spark, sf, "events").withColumn("cluster_id", c("user_id"))
    return ST.alert_once(stream, ST.work_folder(spark), "cluster_id", F.lit(True), ["cluster_id", "event_id"])


_BUCKET = "SELECT epoch_us({b}) // 1000000 AS bucket, count(*) AS requests, sum(CAST(round(value * 100) AS BIGINT)) AS bytes FROM events GROUP BY 1"


@query("t06_five_minute_buckets", _BUCKET.format(b="time_bucket(INTERVAL 5 MINUTE, ts)"))
def t06(spark, sf):
    stream = ST.bucketed(ST.read_landing(spark, sf, "events"), "5 minutes").select(F.unix_seconds("w.start").alias("bucket"), "requests", "bytes")
    return ST.drain_update(stream, ST.work_folder(spark), ["bucket"])


@query("t07_expiring_values", f"SELECT user_id, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 7 DAY > {NOW}")
def t07(spark, sf):
    stream = ST.newest_values(ST.read_landing(spark, sf, "events"), "user_id", "props")
    values = ST.drain_update(stream, ST.work_folder(spark), ["user_id"])
    return ST.live_values(values, now_of(spark, sf)).select("user_id", "props")


@query("t08_urgent_batches", f"SELECT event_id, user_id, value AS score FROM events WHERE value >= 85 AND {B.hours('ts', NOW)} <= 48")
def t08(spark, sf):
    return ST.urgent_batches(ST.read_landing(spark, sf, "events"), ST.work_folder(spark), now_of(spark, sf), c("value"), 48)


@query(
    "t09_latest_records",
    """SELECT event_type, count(*) AS records, CAST(sum(amount) AS BIGINT) AS total, arg_min(event_id, (ts, event_id)) AS oldest
FROM (SELECT event_type, ts, event_id, CAST(round(value * 100) AS BIGINT) AS amount, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) x
WHERE rn <= 200 GROUP BY 1""",
)
def t09_latest(spark, sf):
    """The last 200 records of each kind, as they are kept for a request log."""
    stream = keyed.latest_records(ST.read_landing(spark, sf, "events"), "event_type", F.round(c("value") * 100), 200)
    return ST.drain_update(stream, ST.work_folder(spark), ["event_type"])


@query(
    "t09_rolling_counters",
    "WITH w AS (SELECT unnest([time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE * k FOR k IN range(12)]) AS b, value FROM events) "
    "SELECT epoch_us(b) // 1000000 AS bucket, count(*) AS requests, sum(CAST(round(value * 100) AS BIGINT)) AS bytes FROM w GROUP BY 1",
)
def t09(spark, sf):
    stream = ST.bucketed(ST.read_landing(spark, sf, "events"), "1 hour", "5 minutes").select(F.unix_seconds("w.start").alias("bucket"), "requests", "bytes")
    return ST.drain_update(stream, ST.work_folder(spark), ["bucket"])


# --- evaluation -------------------------------------------------------------------------------


@query(
    "e01_stratified_sample",
    A + """, k AS (SELECT *, md5(article_id || ':a') AS k FROM articles WHERE length(text) > 200), n AS (SELECT greatest(2, 30 // (count(DISTINCT event_type) + 1)) AS e FROM k WHERE event_type <> 'OTHER'),
 r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY k, article_id) AS rn FROM k), named AS (SELECT * FROM r, n WHERE event_type <> 'OTHER' AND rn <= e),
 oth AS (SELECT * FROM r, n WHERE event_type = 'OTHER' AND rn <= greatest(0, 30 - (SELECT count(*) FROM named)))
SELECT article_id, event_type FROM (SELECT * FROM named UNION ALL SELECT * FROM oth) ORDER BY k, article_id LIMIT 30""",
)
def e01(spark, sf):
    rows = D.articles(spark, sf).filter(F.length("text") > 200).select("article_id", "event_type")
    return EV.stratified(rows, "article_id", "event_type", "OTHER", 30, "a").select("article_id", "event_type")


@query(
    "e02_banded_sample",
    A + """, k AS (SELECT article_id, md5(article_id || ':b') AS k, coalesce(final_score, global_score) AS s FROM articles WHERE length(text) > 200), b AS (SELECT *, CASE WHEN s < 40 THEN 0 WHEN s < 70 THEN 1 ELSE 2 END AS band FROM k WHERE s >= 0 AND s < 101)
SELECT article_id, band FROM b QUALIFY row_number() OVER (PARTITION BY band ORDER BY k, article_id) <= CASE band WHEN 1 THEN 9 ELSE 8 END""",
)
def e02(spark, sf):
    rows = D.articles(spark, sf).filter(F.length("text") > 200).select("article_id", F.coalesce("final_score", "global_score").alias("s"))
    return EV.banded(rows, "article_id", "s", [(0, 40, 8), (40, 70, 9), (70, 101, 8)], "b").select("article_id", "band")


def _sql_pairs(stats: str) -> str:
    return f"""picked AS (SELECT cluster_id, top_article FROM {stats} WHERE coverage >= 2 OR (SELECT count(*) FROM {stats} WHERE coverage >= 2) < 4 ORDER BY last_seen DESC, cluster_id LIMIT 100),
 cl AS (SELECT picked.cluster_id, a.article_id, a.event_type FROM picked JOIN articles a ON a.article_id = top_article),
 ents AS (SELECT cl.cluster_id, lower(entity) AS entity FROM cl JOIN entity_rows USING (article_id) QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, entity) <= 3),
 shared AS (SELECT a.cluster_id AS a, b.cluster_id AS b, min(a.entity) AS why, true AS related FROM ents a JOIN ents b ON a.entity = b.entity AND a.cluster_id < b.cluster_id GROUP BY ALL),
 two AS (SELECT * FROM cl WHERE event_type <> 'OTHER' QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(cluster_id || ':c'), cluster_id) <= 2),
 typed AS (SELECT min(cluster_id) AS a, max(cluster_id) AS b, event_type AS why, NULL::BOOLEAN AS related FROM two GROUP BY event_type HAVING count(*) = 2),
 known AS (SELECT * FROM shared UNION ALL SELECT * FROM typed WHERE (a, b) NOT IN (SELECT (a, b) FROM shared)),
 loose AS (SELECT x.cluster_id AS a, y.cluster_id AS b, 'random' AS why, false AS related FROM cl x JOIN cl y ON x.cluster_id < y.cluster_id WHERE (x.cluster_id, y.cluster_id) NOT IN (SELECT (a, b) FROM known))
SELECT a, b, why, related FROM (SELECT *, 0 AS k FROM known UNION ALL SELECT *, 1 FROM loose) ORDER BY k, md5(a || ':' || b || ':c') LIMIT 10"""


def _pairs_of(spark, sf, articles):
    recent = EV.recent_clusters(AG.cluster_stats(articles))
    tops = recent.select("cluster_id", c("top_article_id").alias("article_id")).join(articles.drop("cluster_id").select("article_id", "entities", "event_type"), "article_id")
    first = F.transform(F.slice(F.array_sort(F.transform(F.map_entries("entities"), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("n")))), 1, 3), lambda e: e["n"])
    return EV.pair_samples(tops.select("cluster_id", first.alias("entities"), "event_type"), "c")


@query("e03_pair_sample", B.with_(B.ARTICLES, B.ENTITY_ROWS, CLUSTER) .rstrip() + ", " + _sql_pairs("cstats"))
def e03(spark, sf):
    return _pairs_of(spark, sf, D.articles(spark, sf, text=False))


@query(
    "e03_pair_sample_sparse",
    B.with_(B.ARTICLES.replace("articles AS (", "all_articles AS (", 1), "articles AS (SELECT * REPLACE (article_id AS cluster_id) FROM all_articles)", B.ENTITY_ROWS, CLUSTER).rstrip() + ", " + _sql_pairs("cstats"),
)
def e03_sparse(spark, sf):
    """The same rule where no cluster has two articles."""
    rows = D.articles(spark, sf, text=False).withColumn("cluster_id", c("article_id"))
    return _pairs_of(spark, sf, rows)


def results_of(spark, sf, shift: int = 0):
    i = c("doc_id")
    n = lambda m: (F.pmod(i * m + shift, F.lit(10)) + 1).cast("double")
    return table(spark, sf, "labels").select(
        F.when(c("toxic") == 1, "summary").otherwise("digest").alias("kind"), i.cast("string").alias("sample_id"),
        F.create_map(F.lit("clarity"), n(3), F.lit("depth"), n(7), F.lit("style"), n(9)).alias("scores"),
        F.when(c("quality") == 0, F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>")).alias("errors"),
    )


def _sql_results(shift: int) -> str:
    return (
        f"SELECT CASE WHEN toxic = 1 THEN 'summary' ELSE 'digest' END AS kind, doc_id, quality, unnest(['clarity', 'depth', 'style']) AS dimension, "
        f"unnest([(doc_id * 3 + {shift}) % 10 + 1, (doc_id * 7 + {shift}) % 10 + 1, (doc_id * 9 + {shift}) % 10 + 1])::DOUBLE AS s FROM labels"
    )


@query(
    "e04_summary",
    f"""WITH r AS ({_sql_results(0)}), m AS (SELECT kind, dimension, round_even(avg(s), 2) AS mean FROM r GROUP BY ALL), o AS (SELECT kind, round_even(avg(mean), 2) AS overall FROM m GROUP BY 1),
n AS (SELECT kind, count(DISTINCT doc_id) AS samples, count(DISTINCT doc_id) FILTER (quality = 0) AS failures FROM r GROUP BY 1) SELECT kind, dimension, mean, overall, samples, failures FROM m JOIN o USING (kind) JOIN n USING (kind)""",
)
def e04(spark, sf):
    return EV.summarize(results_of(spark, sf), ["kind"])


@query(
    "e04_worst_samples",
    f"WITH r AS ({_sql_results(0)}), m AS (SELECT kind, CAST(doc_id AS VARCHAR) AS sample_id, round(avg(s), 6) AS mean FROM r GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY kind ORDER BY mean, sample_id) AS pos FROM m QUALIFY pos <= 3",
)
def e04_worst(spark, sf):
    return EV.worst(results_of(spark, sf), ["kind"], "sample_id").select("kind", "sample_id", "mean", "pos")


@query(
    "e05_version_comparison",
    f"""WITH a AS (SELECT kind, dimension, round_even(avg(s), 2) AS m FROM ({_sql_results(0)}) WHERE dimension <> 'style' GROUP BY ALL), b AS (SELECT kind, dimension, round_even(avg(s), 2) AS m FROM ({_sql_results(4)}) WHERE dimension <> 'depth' GROUP BY ALL)
SELECT kind, dimension, coalesce(a.m, 0) AS before, coalesce(b.m, 0) AS after, round(coalesce(b.m, 0) - coalesce(a.m, 0), 6) AS delta FROM a FULL JOIN b USING (kind, dimension)""",
)
def e05(spark, sf):
    a = EV.summarize(results_of(spark, sf), ["kind"]).filter("dimension <> 'style'")
    b = EV.summarize(results_of(spark, sf, 4), ["kind"]).filter("dimension <> 'depth'")
    return EV.compare(a, b, ["kind", "dimension"])


_BLEND = """chg AS (SELECT event_id, g, greatest(g, 0.7 * g + 0.3 * v) AS old, CASE WHEN 0.7 * g + 0.3 * v >= g THEN round_even(0.7 * g + 0.3 * v, 2) ELSE
 round_even(g - least(15.0, (CASE WHEN lab IN ('official', 'confirmed', 'likely') THEN 0.5 ELSE 1 END) * CASE WHEN con = 'official' THEN least(5.0, g - (0.7 * g + 0.3 * v)) ELSE g - (0.7 * g + 0.3 * v) END), 2) END AS new
 FROM (SELECT event_id, (event_id * 37 % 1000) / 10.0 AS g, (event_id * 91 % 1000) / 10.0 AS v, CASE WHEN event_id % 3 = 0 THEN 'official' ELSE 'rumor' END AS con, CASE WHEN event_id % 4 = 0 THEN 'likely' ELSE 'unverified' END AS lab FROM events)),
chd AS (SELECT event_id, round_even(new - old, 2) AS delta, new FROM chg WHERE abs(new - old) > 0.01)"""


def blend_rows(spark, sf):
    e = c("event_id")
    return table(spark, sf, "events").select(
        e, (F.pmod(e * 37, F.lit(1000)) / 10.0).alias("global_score"), (F.pmod(e * 91, F.lit(1000)) / 10.0).alias("verdict"),
        F.when(e % 3 == 0, "official").otherwise("rumor").alias("confirmation"), F.when(e % 4 == 0, "likely").otherwise("unverified").alias("trust_label"),
    )


@query("e07_score_change_report", B.with_(_BLEND) + "SELECT count(*) AS changed, count(*) FILTER (abs(delta) > 5) AS large, min(delta) AS lowest, max(delta) AS highest, round(avg(delta), 4) AS mean FROM chd")
def e07(spark, sf):
    return EV.blend_report(EV.blend_changes(blend_rows(spark, sf), "event_id"))


@query("e07_largest_changes", B.with_(_BLEND) + "SELECT event_id, new, delta FROM chd ORDER BY abs(delta) DESC, event_id LIMIT 10")
def e07_top(spark, sf):
    return EV.blend_changes(blend_rows(spark, sf), "event_id").orderBy(F.abs("delta").desc(), "event_id").limit(10).select("event_id", "new", "delta")


def _ladder(x: str) -> str:
    return f"CASE WHEN {x} <= 0.25 THEN 10 WHEN {x} <= 0.5 THEN 9 WHEN {x} <= 0.75 THEN 7 WHEN {x} <= 1 THEN 5 WHEN {x} <= 1.5 THEN 3 WHEN {x} <= 2 THEN 2 ELSE 1 END"


@query(
    "e08_budget_scores",
    B.with_(_LOG) + f""", b AS (SELECT path, avg_response_bytes, avg_duration_ms, CAST(substr(path, 4) AS INTEGER) AS n FROM roll), s AS (SELECT path, {_ladder('avg_duration_ms / (20 + n * 5)')} AS latency_score, {_ladder('avg_response_bytes / (2000 + n * 400)')} AS size_score,
 avg_response_bytes * (10 + n) AS daily_bytes, avg_response_bytes <= 2000 + n * 400 AS within_budget FROM b)
SELECT *, round_even(sum(daily_bytes) OVER () * 30 / 1073741824, 2) AS monthly_gb, round_even((1 - sum(daily_bytes) OVER () / 1073741824 / 10) * 100, 1) AS reduction_pct FROM s""",
)
def e08(spark, sf):
    n = F.substring("path", 4, 9).cast("int")
    log = request_log(spark, sf)
    budgets = log.select("path").distinct().select("path", (20 + n * 5).alias("max_ms"), (2000 + n * 400).alias("max_bytes"), (10 + n).alias("requests_per_day"))
    return LG.budget_report(LG.request_rollup(log, None), budgets)


_TWO = "array_to_string(string_split(text, '.')[1:2], '.')"


@query(
    "e09_summary_sample",
    A + f", t AS (SELECT article_id, text, {_TWO} AS summary FROM articles) SELECT article_id, substr(text, 1, 2000) AS text, summary FROM t WHERE length(summary) > 30 AND length(text) > 500 ORDER BY md5(article_id || ':s'), article_id LIMIT 20",
)
def e09_summary(spark, sf):
    """Twenty articles with a text and a summary worth judging; the first two sentences stand for the summary."""
    rows = D.articles(spark, sf).select("article_id", "text", F.substring_index("text", ".", 2).alias("summary"))
    return EV.summary_samples(rows, "article_id", "s")


@query(
    "e09_ranked_pool_sample",
    A + """, t AS (SELECT article_id, coalesce(final_score, global_score) AS s, unnest(['all', content_type]) AS tab FROM articles), p AS (SELECT * FROM t WHERE tab <> 'github' QUALIFY row_number() OVER (PARTITION BY tab ORDER BY s DESC, article_id) <= 50)
SELECT tab, article_id FROM p QUALIFY row_number() OVER (PARTITION BY tab ORDER BY md5(article_id || ':d'), article_id) <= 12""",
)
def e09(spark, sf):
    rows = D.articles(spark, sf, text=False).select("article_id", F.coalesce("final_score", "global_score").alias("s"), F.explode(F.array(F.lit("all"), c("content_type"))).alias("tab")).filter("tab <> 'github'")
    pool = R.top_per_group(rows, ["tab"], [F.desc("s"), F.asc("article_id")], 50)
    return R.top_per_group(pool.withColumn("_k", EV.shuffle_key("article_id", "d")), ["tab"], [F.asc("_k"), F.asc("article_id")], 12).select("tab", "article_id")
