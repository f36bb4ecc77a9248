"""Display expressions: category, topic chips, source attribution, payloads, log fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsgraph import constants as K
from newsgraph.functions import maps, text as T, urls as U


def category(event: Column, topics: Column) -> Column:
    """By event type; else the strongest deciding topic of at least .35; else Product; else General."""
    deciding = F.filter(
        maps.ranked_entries(topics), lambda e: (e["weight"] >= 0.35) & e["name"].isin(list(K.TOPIC_CATEGORY))
    )
    by_topic = maps.lookup(K.TOPIC_CATEGORY, F.coalesce(F.try_element_at(deciding, F.lit(1))["name"], F.lit("")))
    product = F.exists(F.map_entries(topics), lambda e: e["key"].isin(K.PRODUCT_TOPICS) & (e["value"] >= 0.42))
    return F.coalesce(
        maps.lookup(K.EVENT_CATEGORY, event), by_topic, F.when(product, "Product").otherwise("General")
    )


def topic_chips(
    category: Column, event: Column, topics: Column, title: Column, summary: Column, source: Column, limit: int = 4
) -> Column:
    """Core chips before context chips, each in display order; a chip equal to the category is hidden."""
    filled = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    text = F.concat_ws(" ", filled(title), filled(summary), filled(source))
    none = F.array().cast("array<string>")
    core_parts, context_parts = [], []
    for chip in K.CHIP_ORDER:
        core_when, context_when = F.lit(False), F.lit(False)
        for event_name, chips in K.EVENT_SEED_CHIPS.items():
            if chip in chips:
                if chip in K.CORE_SEED_CHIPS:
                    core_when = core_when | (event == event_name)
                else:
                    context_when = context_when | (event == event_name)
        for name, bucket, pattern in K.CHIP_KEYWORDS:
            if name == chip:
                hit = T.matches(text, pattern)
                if bucket == "core":
                    core_when = core_when | hit
                else:
                    context_when = context_when | hit
        for topic, chips in K.TOPIC_CHIPS.items():
            if chip in chips:
                hit = maps.weight_of(topics, topic) >= 0.25
                if chip in K.CONTEXT_CHIPS:
                    context_when = context_when | hit
                else:
                    core_when = core_when | hit
        core_parts.append(F.when(core_when, F.lit(chip)))
        context_parts.append(F.when(context_when, F.lit(chip)))
    every = F.array_distinct(F.array_compact(F.array(*core_parts, *context_parts)))
    hidden = F.coalesce(F.array(maps.lookup(K.SUPPRESSED_CHIP, category)), none)
    return F.slice(F.array_except(every, hidden), 1, limit)


def attribution(kind: Column, source_name: Column, url: Column) -> Column:
    """Struct: source, via.  A community post that links elsewhere is credited to the linked publisher."""
    site = U.bare_host(url)
    label = F.regexp_extract(site, r"([^.]+)(?:\.[^.]+)?$", 1)
    brand = maps.lookup(K.HOST_BRANDS, site, T.title_case(F.replace(label, F.lit("-"), F.lit(" "))))
    linked = F.lit(False)
    for platform, hosts in K.PLATFORM_HOSTS.items():
        linked = linked | ((kind == platform) & ~site.isin(hosts))
    linked = linked & (site != "")
    return F.struct(
        F.when(linked, brand).otherwise(source_name).alias("source"),
        F.when(linked & (brand != source_name), source_name).alias("via"),
    )


def compact_json(**fields: Column) -> Column:
    """JSON object without the null fields."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def sql_fingerprint(sql: Column) -> Column:
    """Statement shape: one space between words, literals and value lists masked, first 500 characters."""
    shape = F.trim(F.regexp_replace(sql, r"\s+", " "))
    shape = F.regexp_replace(shape, "'[^']*'", "'?'")
    shape = F.regexp_replace(shape, r"\b\d+\b", "?")
    shape = F.regexp_replace(shape, r"\(\?\s*(?:,\s*\?)*\)", "(?...)")
    return F.substring(shape, 1, 500)


def human_bytes(n: Column) -> Column:
    size = n.cast("double")
    return (
        F.when(size < 1024, F.format_string("%.1f B", size))
        .when(size < 1024**2, F.format_string("%.1f KB", size / 1024))
        .when(size < 1024**3, F.format_string("%.1f MB", size / 1024**2))
        .when(size < 1024**4, F.format_string("%.1f GB", size / 1024**3))
        .otherwise(F.format_string("%.1f TB", size / 1024**4))
    )


def payload_health(status: Column, body: Column, kind: Column) -> Column:
    """Outcome of a fetched source payload."""
    lowered = F.lower(body)
    feed = F.when(kind == "sitemap", body.rlike(r"<urlset|<sitemapindex|<\?xml")).otherwise(
        body.rlike(r"<rss|<feed|<atom|<\?xml|<channel")
    )
    return (
        F.when(status.isin(403, 429), "blocked")
        .when(status == 404, "not_found")
        .when(status == 410, "gone")
        .when(status >= 500, "server_error")
        .when(status != 200, "unexpected_status")
        .when(body.rlike("cf-browser-verification|challenge-platform"), "challenge_page")
        .when(feed, "feed")
        .when(F.contains(lowered, F.lit("<html")), "html_not_feed")
        .otherwise("unrecognised")
    )
