"""The news data model derived from the given tables.

``documents`` are articles (title = an opening phrase and the first line), ``events`` give times,
counters and event types, ``pages`` give URLs, ``embeddings`` give vectors and ``customer`` readers.
Everything joins on the row id, so one partitioning serves all four tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsgraph import constants as K
from newsgraph.functions import features as FT, maps
from newsgraph.sources.tables import spread, table

KINDS = ["rss", "arxiv", "hn", "reddit", "github", "sitemap", "nvd", "twitter", "bluesky", "rss"]
EVENT_OF = {
    "click": "OTHER", "purchase": "STARTUP_FUNDING", "error": "SECURITY_INCIDENT",
    "signup": "PRODUCT_LAUNCH", "view": "MODEL_RELEASE",
}
NAMES = list(K.ENTITY_TIERS) + ["Acme Corp", "Globex Inc"]
HOSTS = [
    "openai.com", "www.nature.com", "github.com", "reddit.com", "arxiv.org", "blog.google", "news.example.com",
    "huggingface.co", "techdaily.example.org", "www.nvidia.com", "x.com", "pypi.org", "doi.org",
]
PATHS = ["/news/item-", "/acme/model/releases/v", "/blog/", "/2024/01/story-", "/docs/guide/"]
LEADS = [
    "Harbor Labs raises $12.5M to build a funding platform",
    "Northwind acquires Bluepeak in a $1.2B deal",
    "Tool maker publishes an open-source agent framework",
    "New GPU accelerator ships with more HBM",
    "Senate hears testimony about the data center bill",
    "City council approves a chatbot policy",
    "Ransomware group claims a data breach, CVE-2024-3094 named",
    "Study sets a benchmark for protein structure",
    "Riverbank announces a multimodal model for hospitals",
    "Introducing Falcon 3 Pro, a new model for coding and reasoning",
    "Weekly notes",
    "GPT-9 turbo is available now with a longer context",
    "Robot arms learn manipulation from video",
    "Speech recognition startup opens a venture round of USD 900k",
    "Teachers test an enterprise AI assistant in the classroom",
    "Governance of AI safety: what the regulation says",
    "System card: the model and tool use in education",
    "Release of the dataset and the research paper",
]
OPENINGS = [
    "The company announced in a statement that it raised $250 million.",
    "Reportedly the plan could change, sources say, and it may be delayed.",
    "According to the report, accuracy rose by 12.5% with 400 tokens.",
    "Correction: the earlier figure was wrong.",
    "Officials denied the claim and called it inaccurate.",
    "We are pleased to announce version 4 of the library; see https://github.com/acme/lib/releases for source code.",
    "People familiar with the matter said that the deal is close.",
    "We propose a method; experiments on a dataset of 7 billion parameters appear in the paper.",
    "As first reported by Daily Ledger the launch slipped.",
    "Today we released the repo and the documentation.",
    "This article was retracted after review.",
    "A quiet day.",
    "OpenAI said it will publish results at https://arxiv.org/abs/2401.00001 soon.",
]


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def title_text(doc_id: Column, text: Column) -> tuple[Column, Column]:
    first_line = F.substring_index(text, "\n", 1)
    return (
        F.concat(pick(LEADS, doc_id), F.lit(" "), first_line),
        F.concat(pick(OPENINGS, doc_id), F.lit(" "), text),
    )


def source_number(source: Column) -> Column:
    return F.regexp_extract(source, r"(\d+)$", 1).cast("long")


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """Publishers: one row per distinct source of the documents."""
    n = source_number(F.col("source"))
    return (
        table(spark, folder, "documents")
        .select("source")
        .distinct()
        .select(
            F.col("source").alias("source_name"),
            pick(KINDS, n).alias("source_kind"),
            (F.pmod(n * 37, F.lit(100)) / 100.0).alias("authority"),
            (F.pmod(n, F.lit(7)) == 0).alias("always_scrape"),
        )
    )


def topics_of(doc_id: Column) -> Column:
    w1 = (F.lit(40) + F.pmod(doc_id, F.lit(5)) * 5) / 100.0
    w2 = (F.lit(30) - F.pmod(doc_id, F.lit(3)) * 5) / 100.0
    full = F.map_from_arrays(
        F.array(pick(K.TOPICS, doc_id), pick(K.TOPICS, doc_id + 3), pick(K.TOPICS, doc_id + 7)),
        F.array(w1, w2, F.lit(0.1)),
    )
    return F.when(F.pmod(doc_id, F.lit(11)) == 0, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))).otherwise(full)


def entities_of(doc_id: Column) -> Column:
    full = F.map_from_arrays(
        F.array(pick(NAMES, doc_id * 7), pick(NAMES, doc_id * 7 + 5), pick(NAMES, doc_id * 7 + 11)),
        F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)),
    )
    return F.when(F.pmod(doc_id, F.lit(13)) == 0, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))).otherwise(full)


def article_events(spark: SparkSession, folder: str) -> DataFrame:
    """One row per article from all its events (ten event ids an article).

    The earliest time, the reader group of the first event, the type of the last, and the sum of the points.
    """
    events = table(spark, folder, "events").withColumn("doc_id", F.floor(F.col("event_id") / 10).cast("long"))
    return events.groupBy("doc_id").agg(
        F.min("ts").alias("ts"), F.min_by("user_id", "event_id").alias("user_id"), F.max_by("event_type", "event_id").alias("raw_type"),
        F.sum(F.round(F.col("value") * 10).cast("long")).cast("int").alias("points"),
    )


def articles(spark: SparkSession, folder: str, text: bool | str = True, docs: DataFrame | None = None) -> DataFrame:
    """Article with its raw item, source fields and grouping.

    ``docs`` may be a stream of documents.  ``text=False`` leaves title and text out; ``text="title"`` adds the title only, so that no exchange carries a text.
    """
    i = F.col("doc_id")
    docs = table(spark, folder, "documents") if docs is None else docs
    title, body = title_text(i, F.col("text"))
    long = {False: [], "title": [title.alias("title")], True: [title.alias("title"), body.alias("text")]}[text]
    docs = docs.select("doc_id", "source", *long)
    docs = spread(docs, "doc_id") if text is True else docs
    events = article_events(spark, folder)
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), "url")
    n = source_number(F.col("source"))
    kind = pick(KINDS, n)
    points = F.col("points")
    minutes = F.pmod(i, F.lit(180))
    fetched = F.timestamp_micros(F.unix_micros("ts") + minutes * 60_000_000)
    built_url = F.concat(F.lit("https://"), pick(HOSTS, i), pick(PATHS, i), i.cast("string"))
    event_type = maps.lookup(EVENT_OF, F.col("raw_type"))
    joined = docs.join(events, "doc_id").join(pages, "doc_id", "left")
    columns = [
        i.alias("article_id"),
        F.col("source").alias("source_name"),
        n.alias("source_no"),
        kind.alias("source_kind"),
        (F.pmod(n * 37, F.lit(100)) / 100.0).alias("authority"),
        F.coalesce(F.col("url"), built_url).alias("final_url"),
        event_type.alias("event_type"),
        FT.content_type(kind, event_type).alias("content_type"),
        topics_of(i).alias("topics"),
        entities_of(i).alias("entities"),
        F.when(F.pmod(i, F.lit(17)) != 0, F.col("ts")).alias("published_at"),
        fetched.alias("fetched_at"),
        F.timestamp_micros(F.unix_micros("ts") + (minutes + 10) * 60_000_000).alias("created_at"),
        F.when(kind == "hn", points).alias("hn_points"),
        F.when(kind == "reddit", points).alias("reddit_upvotes"),
        F.when(kind == "github", points).alias("github_stars"),
        (F.pmod(i * 7919, F.lit(10000)) / 100.0).alias("global_score"),
        F.when(F.pmod(i, F.lit(4)) != 0, F.pmod(i * 104729, F.lit(10000)) / 100.0).alias("final_score"),
        (F.pmod(i * 31, F.lit(1000)) / 10.0).alias("trust_score"),
        pick(["official", "confirmed", "likely", "developing", "unverified", "disputed"], i).alias("trust_label"),
        F.when(F.pmod(i, F.lit(19)) != 0, F.col("user_id")).alias("cluster_id"),
    ]
    return joined.select(*columns, *{False: [], "title": ["title"], True: ["title", "text"]}[text])


def article_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Topics and entities of every document, whether or not events make it an article."""
    i = F.col("doc_id")
    return table(spark, folder, "documents").select(i.alias("article_id"), topics_of(i).alias("topics"), entities_of(i).alias("entities"))


def vectors(spark: SparkSession, folder: str, dim: int = 64) -> DataFrame:
    """Valid vectors only: right dimension, nothing missing."""
    return table(spark, folder, "embeddings").filter(F.size("embedding") == dim).select(
        F.col("vec_id").alias("article_id"), "embedding", "label"
    )


def article_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """A vector for every article: the given ones in turn, so that articles beyond their number share them."""
    ids = table(spark, folder, "documents").select(F.col("doc_id").alias("article_id"))
    given = vectors(spark, folder).select(F.col("article_id").alias("_v"), "embedding")
    # one row, joined in: the number of vectors is not asked for while the plan is built
    number = table(spark, folder, "embeddings").agg(F.count("*").alias("_n"))
    turn = ids.crossJoin(F.broadcast(number)).select("article_id", F.pmod("article_id", F.col("_n")).alias("_v"))
    return turn.join(given, "_v").select("article_id", "embedding")


def readers(spark: SparkSession, folder: str) -> DataFrame:
    """Readers with their preference knobs."""
    k = F.col("c_custkey")
    step = lambda m, lo: (F.lit(lo) + F.pmod(k, F.lit(m))) / 10.0
    return table(spark, folder, "customer").select(
        k.alias("user_id"),
        step(5, 8).alias("prefer_research"),
        step(4, 8).alias("prefer_startups"),
        step(3, 9).alias("prefer_hardware"),
        step(6, 7).alias("prefer_open_source"),
        step(7, 7).alias("prefer_policy_safety"),
        step(8, 6).alias("prefer_tutorials_tools"),
        (F.pmod(k, F.lit(2)) == 0).alias("prefer_official_sources"),
        step(9, 6).alias("credibility_bias"),
        step(10, 5).alias("hype_tolerance"),
        step(5, 8).alias("recency_bias"),
        (F.lit(30.0) + F.pmod(k, F.lit(5)) * 5.0).alias("min_show_score"),
        F.lit(85.0).alias("min_urgent_score"),
        F.when(F.col("c_acctbal") < 0, 0.0).otherwise(0.15).alias("serendipity"),
    )


def default_reader(spark: SparkSession) -> DataFrame:
    """The reader without stored preferences."""
    return spark.range(1).select(
        F.lit(0).cast("long").alias("user_id"),
        *[
            F.lit(1.0).alias(c)
            for c in (
                "prefer_research", "prefer_startups", "prefer_hardware", "prefer_open_source",
                "prefer_policy_safety", "prefer_tutorials_tools", "credibility_bias", "hype_tolerance",
                "recency_bias",
            )
        ],
        F.lit(False).alias("prefer_official_sources"),
        F.lit(55.0).alias("min_show_score"),
        F.lit(85.0).alias("min_urgent_score"),
        F.lit(0.15).alias("serendipity"),
    )


def reader_weights(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Long weight tables (user_id, key, weight, blocked), by kind."""
    k = F.col("c_custkey")
    base = table(spark, folder, "customer")

    def rows(key: Column, weight: Column, blocked: Column) -> DataFrame:
        return base.select(k.alias("user_id"), key.alias("key"), weight.alias("weight"), blocked.alias("blocked"))

    return {
        "entity": rows(pick(NAMES, k), (F.lit(6) + F.pmod(k, F.lit(10))) / 10.0, F.pmod(k, F.lit(29)) == 0),
        "topic": rows(pick(K.TOPICS, k), (F.lit(7) + F.pmod(k, F.lit(8))) / 10.0, F.pmod(k, F.lit(31)) == 0),
        "source": rows(
            F.concat(F.lit("src"), F.pmod(k, F.lit(20)).cast("string")),
            (F.lit(7) + F.pmod(k, F.lit(7))) / 10.0,
            F.pmod(k, F.lit(37)) == 0,
        ),
    }
