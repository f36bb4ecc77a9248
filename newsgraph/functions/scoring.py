"""Score expressions: signals, importance, rank, decay, personal score, triage."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from newsgraph import constants as K
from newsgraph.functions import maps, text as T, urls as U


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def log_share(value: Column, top: float) -> Column:
    """log1p(value) over log1p(top), clamped; 0 for nothing."""
    v = F.coalesce(value.cast("double"), F.lit(0.0))
    return F.when(v <= 0, F.lit(0.0)).otherwise(clamp(F.log1p(F.greatest(v, F.lit(0.0))) / math.log1p(top)))


# --- time -------------------------------------------------------------------------------------

def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 3.6e9


def event_time(kind: Column, published: Column, fetched: Column) -> Column:
    return (
        F.when(kind.isin(K.FETCHED_ALWAYS_KINDS), fetched)
        .when(published.isNotNull(), published)
        .when(kind.isin(K.FETCHED_FALLBACK_KINDS), fetched)
    )


def is_fresh(kind: Column, published: Column, fetched: Column, cutoff: Column) -> Column:
    return (
        F.coalesce(published >= cutoff, F.lit(False))
        | (published.isNull() & kind.isin(K.FETCHED_FALLBACK_KINDS) & (fetched >= cutoff))
        | (kind.isin(K.FETCHED_ALWAYS_KINDS) & (fetched >= cutoff))
    )


def decay_factor(event: Column, age: Column, content: Column) -> Column:
    half = F.when(content == "github", F.lit(48.0)).otherwise(maps.lookup(K.HALF_LIFE_HOURS, event, 18.0))
    return F.pow(F.lit(2.0), -age / half)


def decayed_rank_of(score: Column, decay: Column) -> Column:
    return maps.round_half_even(score * decay, 2)


def decayed_rank(score: Column, event: Column, age: Column, content: Column) -> Column:
    return decayed_rank_of(score, decay_factor(event, age, content))


def feed_rank(score: Column, age: Column, recency_bias: Column, base: float) -> Column:
    return score * F.pow(F.lit(2.0), -age / (F.lit(base) / F.greatest(recency_bias, F.lit(0.01))))


# --- signals ----------------------------------------------------------------------------------

def entity_prominence(entities: Column) -> Column:
    best = F.array_max(
        F.transform(
            F.map_entries(entities),
            lambda e: maps.lookup(K.ENTITY_TIERS, e["key"], K.UNKNOWN_ENTITY_TIER) * clamp(e["value"]),
        )
    )
    return F.when(entities.isNull() | (F.size(entities) == 0), F.lit(0.3)).otherwise(clamp(best))


def event_impact(event: Column) -> Column:
    return maps.lookup(K.EVENT_IMPACT, event, 0.40)


def corroboration(sources: Column) -> Column:
    """Lower confidence bound for the share of eight sources, z = 1.64."""
    z2 = 1.64 * 1.64
    n = F.greatest(sources, F.lit(1)).cast("double")
    p = F.least(sources / 8.0, F.lit(1.0))
    spread = 1.64 * F.sqrt((p * (1.0 - p) + z2 / (4.0 * n)) / n)
    low = (p + z2 / (2.0 * n) - spread) / (1.0 + z2 / n)
    return F.when(sources <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), low))


def social_velocity(hn: Column, reddit: Column, stars: Column, age: Column) -> Column:
    hours = F.greatest(age, F.lit(0.1))
    rate = lambda c: F.coalesce(c, F.lit(0)) / hours
    return clamp(
        0.45 * log_share(rate(hn), 200) + 0.30 * log_share(rate(reddit), 500) + 0.25 * log_share(rate(stars), 100)
    )


def cluster_velocity(articles: Column, age: Column) -> Column:
    return log_share(F.greatest(articles - 1, F.lit(0)) / F.greatest(age, F.lit(0.1)), 10)


def novelty(similarity: Column, recent_max: Column) -> Column:
    s = clamp(similarity) * clamp(recent_max / 100.0)
    return F.when(s >= 0.85, F.lit(0.0)).otherwise(clamp(1.0 / (1.0 + F.exp(10.0 * (s - 0.7)))))


def rarity(share: Column) -> Column:
    """Surprise of an event type given its share of recent items; .5 without history."""
    bits = -F.log2(F.greatest(share, F.lit(1e-6)))
    return F.coalesce(F.least(F.lit(1.0), bits / -math.log2(1e-6)), F.lit(0.5))


def funding(amount: Column) -> Column:
    return log_share(amount, 5_000_000_000)


def research_rigor(kind: Column, text: Column, size: int | None = 5000) -> Column:
    opening = T.opening(F.lower(F.coalesce(text, F.lit(""))), size)
    holds = lambda *p: T.any_match(opening, list(p))
    return (
        F.when(kind == "arxiv", 0.90)
        .when(holds(*K.RIGOR_IDENTIFIERS), 0.70)
        .when(holds(*K.RIGOR_WORDS), 0.55)
        .otherwise(0.35)
    )


def source_diversity(distinct_sources: Column, articles: Column) -> Column:
    return F.when(F.coalesce(articles, F.lit(0)) <= 1, F.lit(0.5)).otherwise(clamp(distinct_sources / articles))


def importance(
    event: Column, content: Column, signals: dict[str, Column], official: Column, independent: Column,
    funding_usd: Column, quality: Column,
) -> Column:
    """Base by event type, a bonus per signal, extras by content type and officialness, low-quality discount."""
    score = maps.lookup(K.BASE_IMPORTANCE, event, K.BASE_IMPORTANCE["OTHER"])
    for name, bonus in K.SIGNAL_BONUSES.items():
        score = score + F.lit(bonus) * signals[name]
    score = score + (
        F.when(content == "research", 4.0 * signals["research_rigor"] + 4.0 * signals["novelty"])
        .when(content == "github", 4.0 * signals["social_velocity"] + 4.0 * signals["novelty"])
        .otherwise(0.0)
    )
    score = score + F.when(official, 8.0).otherwise(0.0)
    release = (event == "MODEL_RELEASE") & official
    lifted = (
        score + 10.0
        + F.when(signals["entity_prominence"] >= 0.7, 4.0).otherwise(0.0)
        + F.when(signals["authority"] >= 0.9, 2.0).otherwise(0.0)
    )
    score = (
        F.when(release, F.greatest(lifted, F.lit(90.0)))
        .when(event.isin(K.CONFIRMED_EVENT_TYPES) & (independent >= 3), score + 5.0)
        .otherwise(score)
    )
    score = score + F.when(F.coalesce(funding_usd, F.lit(0)) >= 1_000_000_000, 4.0).otherwise(0.0)
    score = F.least(F.lit(100.0), maps.round_half_even(score, 2))
    return F.when(quality <= 0.30, maps.round_half_even(score * (0.70 + 0.30 * (quality / 0.30)), 2)).otherwise(score)


def editorial_rank(top: Column, coverage: Column, independent: Column, official: Column, trust: Column) -> Column:
    """A missing or zero trust counts as 40, i.e. no penalty."""
    known = F.when(F.coalesce(trust, F.lit(0.0)) == 0, F.lit(40.0)).otherwise(trust)
    raw = (
        top
        + F.least(coverage / 5.0, F.lit(1.0)) * 5.0
        + F.least(independent / 4.0, F.lit(1.0)) * 5.0
        + F.when(official, 3.0).otherwise(0.0)
        - F.greatest(F.lit(0.0), (F.lit(40.0) - known) * 0.1)
    )
    return clamp(maps.round_half_even(raw, 2), 0.0, 100.0)


# --- verdict blending -------------------------------------------------------------------------

def significance(impact: Column, breadth: Column, novel: Column) -> Column:
    raw = 0.50 * impact + 0.25 * breadth + 0.25 * novel
    return maps.round_half_even(clamp((raw - 1.0) * 100.0 / 9.0, 0.0, 100.0), 2)


def final_score(
    rule: Column, verdict: Column, confirmation: Column, label: Column, state: Column, confidence: Column,
    update: Column,
) -> Column:
    """Upward moves are free; downward moves are damped by evidence and capped at 20 points."""
    mixed = 0.55 * rule + 0.45 * verdict
    drop = rule - mixed
    drop = F.when(
        state.isin("verified_artifact", "official_statement", "corroborated_report"), drop * 0.5
    ).otherwise(drop)
    solid = (state == "single_source_report") & (F.coalesce(confidence, F.lit(0.0)) >= 70)
    drop = F.when(solid, drop * 0.75).otherwise(drop)
    drop = F.when(confirmation == "official", F.least(drop, F.lit(5.0))).otherwise(drop)
    drop = F.when(label.isin("official", "confirmed", "likely"), drop * 0.5).otherwise(drop)
    drop = F.least(drop, F.lit(20.0))
    return (
        F.when(verdict.isNull(), rule)
        .when(update.isin("corrected", "retracted"), maps.round_half_even(F.least(rule, 0.5 * rule + 0.5 * verdict), 2))
        .when(mixed >= rule, maps.round_half_even(mixed, 2))
        .otherwise(maps.round_half_even(rule - drop, 2))
    )


def is_urgent(
    score: Column, age: Column, independent: Column, official: Column, label: Column, state: Column,
    confidence: Column,
) -> Column:
    sure = F.coalesce(confidence, F.lit(0.0)) >= 70
    by_state = (
        F.when(state.isin("disputed", "corrected_or_retracted"), False)
        .when(state.isin("verified_artifact", "official_statement", "corroborated_report", "single_source_report"), sure)
        .otherwise(False)
    )
    trusted = label.isNull() | (label == "") | label.isin("official", "confirmed", "likely")
    by_label = trusted & ((independent >= 2) | official)
    return (
        F.when((score < 85) | (age > 6), False)
        .when(state.isNotNull() & (state != ""), by_state)
        .otherwise(by_label)
    )


# --- personal score ---------------------------------------------------------------------------

def domain_vector(event: Column, topics: Column) -> dict[str, Column]:
    def or_topic(events: list[str], topic: str) -> Column:
        return F.when(event.isin(events), F.lit(1.0)).otherwise(maps.weight_of(topics, topic))

    return {
        "research": or_topic(["RESEARCH_PAPER", "BENCHMARK_RESULT"], "research_methods"),
        "startups": or_topic(["STARTUP_FUNDING", "M_AND_A"], "startups_funding"),
        "hardware": or_topic(["CHIP_HARDWARE"], "hardware_chips"),
        "open_source": or_topic(["OPEN_SOURCE_RELEASE"], "open_source"),
        "policy": or_topic(["POLICY_REGULATION"], "safety_policy"),
        "tools": maps.weight_of(topics, "enterprise_apps"),
    }


DOMAIN_PREFS = {
    "research": "prefer_research", "startups": "prefer_startups", "hardware": "prefer_hardware",
    "open_source": "prefer_open_source", "policy": "prefer_policy_safety", "tools": "prefer_tutorials_tools",
}


def reader_view(event: Column, topics: Column, entities: Column, official: Column) -> Column:
    """What a personal score needs of an item alone: worked out once an item where it meets many readers."""
    return F.struct(
        F.struct(*(value.alias(name) for name, value in domain_vector(event, topics).items())).alias("domains"),
        F.slice(maps.ranked_entries(entities), 1, 5).alias("entities"), F.array_sort(F.map_entries(topics)).alias("topics"), official.alias("official"))


def personal_score(
    base: Column, event: Column, topics: Column, entities: Column, source: Column, authority: Column,
    coverage: Column, social: Column, official: Column,
) -> Column:
    """Score for a reader whose preference columns are in the row.

    Weight maps hold struct<weight, blocked> per key: ``entity_weights``, ``topic_weights``, ``source_weights``.
    ``operators/offers.py`` is the same rule for many readers and items.
    """
    pref = lambda name: F.col(name)
    setting = lambda name, key: F.try_element_at(F.col(name), key)
    domain = F.lit(1.0)
    for key, value in domain_vector(event, topics).items():
        domain = domain * F.pow(pref(DOMAIN_PREFS[key]), value)
    domain = clamp(domain, 0.5, 1.8)

    def factor(name: str, key: Column, power: Column) -> Column:
        return F.pow(clamp(F.coalesce(setting(name, key)["weight"], F.lit(1.0)), 0.6, 1.6), power)

    def is_blocked(name: str, key: Column) -> Column:
        return F.coalesce(setting(name, key)["blocked"], F.lit(False))

    top = F.slice(maps.ranked_entries(entities), 1, 5)
    topic_list = F.array_sort(F.map_entries(topics))
    entity_part = maps.product(F.transform(top, lambda e: factor("entity_weights", e["name"], e["weight"])))
    topic_part = maps.product(F.transform(topic_list, lambda e: factor("topic_weights", e["key"], e["value"])))
    source_part = clamp(F.coalesce(setting("source_weights", source)["weight"], F.lit(1.0)), 0.7, 1.3)
    source_part = source_part * F.when(
        pref("prefer_official_sources"), F.when(official, 1.05).otherwise(0.98)
    ).otherwise(1.0)
    credible = clamp(1.0 + 0.10 * (pref("credibility_bias") - 1.0) * (authority + coverage - 1.0), 0.85, 1.15)
    hype = clamp(1.0 + 0.10 * (pref("hype_tolerance") - 1.0) * (social - authority), 0.85, 1.15)
    blocked = (
        F.exists(top, lambda e: is_blocked("entity_weights", e["name"]))
        | F.exists(topic_list, lambda e: is_blocked("topic_weights", e["key"]) & (e["value"] >= 0.35))
        | is_blocked("source_weights", source)
    )
    score = base * domain * entity_part * topic_part * source_part * credible * hype
    return F.when(blocked, F.lit(0.0)).otherwise(F.least(F.lit(100.0), maps.round_half_even(score, 2)))


# --- triage -----------------------------------------------------------------------------------

def keyword_score(title: Column) -> Column:
    lowered = F.lower(title)
    score = F.lit(0.0)
    for phrase, weight in K.KEYWORD_WEIGHTS.items():
        score = score + F.when(F.contains(lowered, F.lit(phrase)), weight).otherwise(0.0)
    return clamp(score)


def social_score(hn: Column, reddit: Column, stars: Column) -> Column:
    return F.greatest(log_share(hn, 500), log_share(reddit, 5000), log_share(stars, 5000))


def pre_score(authority: Column, relevance: Column, keyword: Column, social: Column) -> Column:
    return 100.0 * clamp(0.35 * authority + 0.30 * relevance + 0.20 * keyword + 0.15 * social)


def scrape_decision(always: Column, relevance: Column, title: Column, pre: Column, authority: Column) -> Column:
    lowered = F.lower(title)
    verb = F.lit(False)
    for word in K.FORCE_FETCH_WORDS:
        verb = verb | F.contains(lowered, F.lit(word))
    choice = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    return (
        F.when(always, choice("fetch_full", "always_scrape"))
        .when((relevance >= 0.75) & verb, choice("fetch_full", "ai_relevance_force_fetch"))
        .when(pre >= 70, choice("fetch_full_priority", "pre_score>=70"))
        .when(pre >= 40, choice("fetch_full", "pre_score>=40"))
        .when((pre >= 30) & ((authority >= 0.70) | (relevance >= 0.60)), choice("fetch_watch", "watch_band"))
        .otherwise(choice("skip", "below_threshold_skip"))
    )
