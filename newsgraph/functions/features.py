"""Feature expressions: event type, releases, entities, topics, hashed word vectors."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgraph import constants as K
from newsgraph.functions import maps, text as T, urls as U

DIMENSIONS = 384


# --- event and content type -------------------------------------------------------------------

def content_type(kind: Column, event_type: Column) -> Column:
    return (
        F.when(kind.isin("github", "github_trending"), "github")
        .when((kind == "arxiv") | (event_type == "RESEARCH_PAPER"), "research")
        .otherwise("news")
    )


def event_type(title: Column, kind: Column) -> Column:
    result = F.when(kind == "arxiv", "RESEARCH_PAPER").when(kind == "nvd", "SECURITY_INCIDENT")
    for name, pattern in K.EVENT_RULES:
        result = result.when(T.matches(title, pattern), name)
    return result.otherwise("OTHER")


def event_family(event: Column) -> Column:
    key = F.lower(F.trim(event))
    return F.when(key == "", "other").otherwise(maps.lookup(K.EVENT_FAMILIES, key, key))


# --- official releases ------------------------------------------------------------------------

def source_entity(source_name: Column, url: Column) -> Column:
    site = U.host(url)
    name = F.lower(F.coalesce(source_name, F.lit("")))
    result = None
    for domain, entity in K.SOURCE_ENTITY_BY_DOMAIN.items():
        hit = (site == domain) | F.endswith(site, F.lit("." + domain))
        result = F.when(hit, entity) if result is None else result.when(hit, entity)
    for hint, entity in K.SOURCE_ENTITY_BY_NAME.items():
        result = result.when(F.contains(name, F.lit(hint.lower())), entity)
    return result


def release_assessment(title: Column, text: Column, url: Column, source_name: Column, near_size: int | None = 400, wide_size: int | None = 1200) -> Column:
    """Struct: official, is_release, confidence, artifact_name, source_entity, evidence."""
    filled = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    near = F.concat_ws(" ", filled(title), filled(url), filled(T.opening(F.coalesce(text, F.lit("")), near_size)))
    wide = F.concat_ws(" ", filled(title), filled(T.opening(F.coalesce(text, F.lit("")), wide_size)), filled(url))
    names = [F.nullif(F.regexp_extract(near, p, 1), F.lit("")) for p in K.ARTIFACT_NAME_PATTERNS]
    artifact = F.trim(F.regexp_replace(F.coalesce(*names), r"\s+", " "))
    # "system card" and "system-card" count separately but only their presence matters.
    facts = F.struct(
        U.is_official(url).alias("official"), artifact.alias("artifact"), T.any_match(wide, K.SYSTEM_CARD).alias("card"), T.any_match(wide, K.NON_RELEASE).alias("other"),
        T.count_matching(wide, K.RELEASE_FRAMING).alias("release"), T.count_matching(wide, K.MODEL_CAPABILITY).alias("capability"),
    )
    owner = source_entity(source_name, url)
    # each pattern is searched once a row
    return maps.let(facts, lambda f: _assessed(f["official"], f["artifact"], f["release"], f["capability"], f["card"], f["other"], owner))


def _assessed(official: Column, artifact: Column, release: Column, capability: Column, card: Column, other: Column, owner: Column) -> Column:
    evidence = (
        F.when(official, 3).otherwise(0)
        + F.when(artifact.isNotNull(), 3).otherwise(0)
        + F.when(release > 0, 2).otherwise(0)
        + F.least(capability, F.lit(2))
        + F.when(card, 2).otherwise(0)
        - F.when(other & artifact.isNull(), 2).otherwise(0)
    )
    enough = card | ((release >= 1) & (capability >= 2)) | ((release >= 2) & (capability >= 1))
    return F.struct(
        official.alias("official"),
        (official & artifact.isNotNull() & enough).alias("is_release"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), evidence / 10.0)).alias("confidence"),
        artifact.alias("artifact_name"),
        owner.alias("source_entity"),
        evidence.alias("evidence"),
    )


# --- entity and topic maps --------------------------------------------------------------------

def merge_source_entity(entities: Column, entity: Column, promote: Column) -> Column:
    """Add the publisher's own entity and renormalise; an already present one changes only when promoted."""
    floor = F.when(promote, F.lit(0.85)).otherwise(F.lit(0.55))
    own = F.create_map(F.coalesce(entity, F.lit("")), floor)
    merged = F.map_zip_with(
        entities, own, lambda _k, a, b: F.greatest(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0)))
    )
    share = maps.let(merged, lambda m: maps.let(
        maps.total(m), lambda whole: F.transform_values(m, lambda _k, v: v / F.when(whole == 0, 1.0).otherwise(whole))))
    return (
        F.when(entity.isNull() | (entity == ""), entities)
        .when(F.size(entities) == 0, F.create_map(F.coalesce(entity, F.lit("")), F.lit(1.0)))
        .when(F.map_contains_key(entities, F.coalesce(entity, F.lit(""))) & ~promote, entities)
        .otherwise(share)
    )


def boost_release_topics(topics: Column) -> Column:
    """Language models get at least .72; the other topics share .28; renormalised."""
    others = F.map_filter(topics, lambda k, _v: k != "llms")
    rest = maps.total(others)
    rest = F.when(rest == 0, 1.0).otherwise(rest)
    llms = F.greatest(maps.weight_of(topics, "llms"), F.lit(0.72))
    boosted = F.map_concat(
        F.transform_values(others, lambda _k, v: F.lit(0.28) * (v / rest)), F.create_map(F.lit("llms"), llms)
    )
    whole = maps.total(boosted)
    return F.transform_values(boosted, lambda _k, v: v / whole)


def entity_key(name: Column) -> Column:
    """Comparison key: lower case, accents folded, symbols, corporate suffixes and spaces removed."""
    plain = F.translate(
        F.lower(F.trim(name)),
        "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ",
        "aaaaaaceeeeiiiinooooouuuuyy",
    )
    words = F.regexp_replace(plain, r"[^A-Za-z0-9_\s]", " ")
    return F.regexp_replace(F.regexp_replace(words, "(?i)" + K.CORPORATE_SUFFIXES, " "), r"\s+", "")


# --- hashed word vectors ----------------------------------------------------------------------

def bucket_of(word: str) -> int:
    return int.from_bytes(hashlib.sha256(word.encode()).digest()[:4], "little") % DIMENSIONS


def word_bucket(word: Column) -> Column:
    """First four bytes of the digest as a little-endian number, modulo the dimension."""
    hexed = F.sha2(word, 256)
    swapped = F.concat(*[F.substring(hexed, i, 2) for i in (7, 5, 3, 1)])
    return F.pmod(F.conv(swapped, 16, 10).cast("long"), F.lit(DIMENSIONS)).cast("int")


def explode_once(values: Column) -> Column:
    """Explode an expensive expression.  A plain explode also puts the expression into an inferred
    not-empty filter and computes it again there; the outer form does not (empty rows carry a null)."""
    return F.explode_outer(values)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def word_vectors(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sparse unit vectors, one row per (key, bucket).

    Words become buckets before anything is shuffled, so the exchange carries at most DIMENSIONS counts of a key.
    """
    counts = (
        df.select(key, explode_once(words(F.col(text))).alias("word"))
        .filter("word is not null")
        .select(key, word_bucket(F.col("word")).alias("bucket"))
        .groupBy(key, "bucket")
        .agg(F.count("*").alias("n"))
    )
    # A key has at most DIMENSIONS buckets, so its window is small.
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counts.select(key, "bucket", (F.col("n") / norm).alias("weight"))


@lru_cache(maxsize=1)
def _anchor_rows() -> tuple:
    """(topic, {bucket: unit weight}) for every anchor phrase."""
    rows = []
    for topic, phrases in K.TOPIC_ANCHORS.items():
        for phrase in phrases:
            counts: dict[int, float] = {}
            for word in re.findall("[a-z0-9]+", phrase.lower()):
                counts[bucket_of(word)] = counts.get(bucket_of(word), 0.0) + 1.0
            norm = sum(v * v for v in counts.values()) ** 0.5
            rows.append((topic, {b: v / norm for b, v in sorted(counts.items())}))
    return tuple(rows)


def with_anchor_similarity(df: DataFrame, text: Column, name: str) -> DataFrame:
    return df.withColumn(name, anchor_similarity(text))


def anchor_similarity(text: Column) -> Column:
    """Similarity of ``text`` to every anchor phrase, per topic the best, as an array.

    The text is short (a title, or a title with an opening), so everything stays inside the row:
    hash the words once, then read each anchor's buckets off the sorted list.
    """
    anchor_buckets = sorted({b for _topic, weights in _anchor_rows() for b in weights})
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("squares"))

    def step(acc: Column, b: Column) -> Column:
        run = F.when(b == acc["last"], acc["run"] + 1).otherwise(1)
        return F.struct(b.alias("last"), run.alias("run"), (acc["squares"] + 2.0 * run - 1.0).alias("squares"))

    def norm(buckets: Column) -> Column:
        return F.sqrt(F.aggregate(buckets, start, step, lambda acc: acc["squares"]))

    def count_of(kept: Column, bucket: int) -> Column:
        return F.size(F.filter(kept, lambda b: b == bucket))

    def per_topic(kept: Column, length: Column) -> Column:
        best = []
        for topic in K.TOPICS:
            sims = []
            for anchor_topic, weights in _anchor_rows():
                if anchor_topic == topic:
                    hits = F.lit(0.0)
                    for bucket, weight in weights.items():
                        hits = hits + count_of(kept, bucket) * F.lit(weight)
                    sims.append(hits)
            best.append(F.greatest(*sims) / length)
        return F.array(*best)

    empty = F.array(*[F.lit(0.0)] * len(K.TOPICS))
    return maps.let(
        F.array_sort(F.transform(words(text), word_bucket)),
        lambda buckets: maps.let(
            F.filter(buckets, lambda b: b.isin(anchor_buckets)),
            lambda kept: F.when(F.size(kept) == 0, empty).otherwise(
                maps.let(norm(buckets), lambda length: per_topic(kept, length))
            ),
        ),
    )


def topic_distribution(similarity: Column, temperature: float = 0.07) -> Column:
    """Softmax over the per-topic similarities, as a map."""
    names = F.array(*[F.lit(t) for t in K.TOPICS])

    def softmax(sims: Column) -> Column:
        return maps.let(
            F.array_max(sims),
            lambda top: maps.let(
                F.transform(sims, lambda s: F.exp(s / temperature - top)),
                lambda scores: maps.let(
                    F.aggregate(scores, F.lit(0.0), lambda a, s: a + s),
                    lambda whole: F.transform(scores, lambda s: s / whole),
                ),
            ),
        )

    return F.map_from_arrays(names, maps.let(similarity, softmax))


def relevance(similarity: Column) -> Column:
    """Closeness to the best anchor, stretched to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.array_max(similarity) - 0.15) / 0.35))


# --- entity mentions --------------------------------------------------------------------------

def entity_mentions(df: DataFrame, key: str, text: str, aliases: DataFrame, limit: int = 5) -> DataFrame:
    """Top entities per row by number of mentions, weight = share among the kept ones.

    ``aliases`` has ``alias`` (lower case words, of any number) and ``canonical``, and is small enough to broadcast.  A
    word that opens an alias meets those that it opens in an equi-join, and the run of as many words is compared.
    """
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{N}#&]+)"), 1)
    opened = aliases.select("alias", "canonical", F.split("alias", " ").alias("_words"))
    opened = opened.select("canonical", "_words", F.element_at("_words", 1).alias("_first"), F.size("_words").alias("_size"))
    heads = opened.agg(F.max("_size").alias("_most"), F.collect_set("_first").alias("_heads"))
    # few words of a text open an alias; only those start a run, as long as the longest alias
    staged = df.select(key, tokens.alias("_t")).crossJoin(F.broadcast(heads)).withColumn("_hits", F.array_intersect("_t", "_heads")).filter(F.size("_hits") > 0)
    starts = F.filter(F.sequence(F.lit(1), F.size("_t")), lambda at: F.array_contains(F.col("_hits"), F.element_at(F.col("_t"), at)))
    runs = staged.select(key, explode_once(F.transform(starts, lambda at: F.slice(F.col("_t"), at, F.col("_most")))).alias("_run"))
    found = (
        runs.withColumn("_first", F.element_at("_run", 1))
        .join(opened, "_first")
        .filter(F.slice("_run", 1, F.col("_size")) == F.col("_words"))
        .groupBy(key, "canonical")
        .agg(F.count("*").alias("mentions"))
    )
    from newsgraph.operators.ranking import top_per_group

    kept = top_per_group(found, [key], [F.desc("mentions"), F.asc("canonical")], limit)
    whole = kept.groupBy(key).agg(F.sum("mentions").alias("whole"))
    return kept.join(whole, key).select(
        key, F.col("canonical").alias("entity"), (F.col("mentions") / F.col("whole")).alias("weight")
    )


def static_aliases(spark) -> DataFrame:
    rows = sorted({(a.lower(), name) for name, names in K.ENTITY_ALIASES.items() for a in names})
    return spark.createDataFrame(rows, "alias string, canonical string")


# --- the whole feature row --------------------------------------------------------------------

def build_features(items: DataFrame, aliases: DataFrame, mention_size: int | None = 2000, topic_size: int | None = 1000) -> DataFrame:
    """(article_id, event_type, topics, entities, funding_usd) from title and text.

    The openings of 1,000 and 2,000 characters are part of the definition of topics and mentions.
    """
    c = F.col
    opening = F.concat(c("title"), F.lit("\n"), T.opening(F.coalesce("text", F.lit("")), mention_size))
    topic_text = F.when(
        F.coalesce("text", F.lit("")) != "", F.concat(c("title"), F.lit("\n"), T.opening("text", topic_size))
    ).otherwise(c("title"))
    staged = with_anchor_similarity(items, topic_text, "_sims").select(
        "article_id", opening.alias("_opening"), topic_distribution(c("_sims")).alias("_topics"),
        event_type(c("title"), c("source_kind")).alias("_event"), T.funding_amount(opening).alias("funding_usd"),
        release_assessment(c("title"), c("text"), c("final_url"), c("source_name")).alias("_release"),
    )
    found = entity_mentions(staged, "article_id", "_opening", aliases)
    # At most five entities per item.
    grouped = found.groupBy("article_id").agg(
        F.map_from_entries(F.collect_list(F.struct("entity", "weight"))).alias("_entities")
    )
    empty = F.expr("cast(map() as map<string,double>)")
    release, owner = c("_release.is_release"), c("_release.source_entity")
    merged = merge_source_entity(c("_found"), owner, F.lit(False))
    return (
        staged.join(grouped, "article_id", "left")
        .withColumn("_found", F.coalesce("_entities", empty))
        .withColumn("_merged", F.explode_outer(F.array(merged)))  # worked out once
        .select(
            "article_id",
            F.when(release, "MODEL_RELEASE").otherwise(c("_event")).alias("event_type"),
            F.when(release, boost_release_topics(c("_topics"))).otherwise(c("_topics")).alias("topics"),
            F.when(release, merge_source_entity(c("_merged"), owner, F.lit(True))).otherwise(c("_merged")).alias("entities"),
            "funding_usd",
        )
    )
