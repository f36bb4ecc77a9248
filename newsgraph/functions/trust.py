"""Trust and verification expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from newsgraph import constants as K
from newsgraph.functions import maps, scoring as S, text as T, urls as U


def corroboration_trust(independent: Column, average_authority: Column) -> Column:
    breadth = F.least(F.lit(1.0), F.log(1.0 + F.greatest(independent, F.lit(0))) / math.log(11))
    return F.when(independent <= 0, F.lit(0.1)).otherwise(breadth * (0.5 + 0.5 * S.clamp(average_authority)))


def source_trust(authority: Column, primary: Column) -> Column:
    base = S.clamp(authority)
    return F.when(primary, F.least(F.lit(1.0), base * 1.15)).otherwise(base)


def claim_quality(text: Column, size: int | None = 5000) -> Column:
    """Struct: quality, hedging, attribution, specificity."""
    sample = T.opening(F.lower(F.coalesce(text, F.lit(""))), size)

    def measure(sentences: Column) -> Column:
        n = F.greatest(F.size(sentences), F.lit(1))
        share = lambda patterns: F.size(F.filter(sentences, lambda s: T.any_match(s, patterns))) / n
        return F.struct(share(K.HEDGES).alias("hedging"), share(K.ATTRIBUTIONS).alias("attribution"))

    def judge(shares: Column) -> Column:
        specificity = F.least(T.count_matching(sample, K.SPECIFICS) / 3.0, F.lit(1.0))
        attribution = F.least(shares["attribution"], F.lit(1.0))
        quality = S.clamp(0.40 * (1.0 - shares["hedging"]) + 0.35 * attribution + 0.25 * specificity)
        blank = F.coalesce(text, F.lit("")) == ""
        pick = lambda c, d: F.when(blank, F.lit(d)).otherwise(c)
        return F.struct(
            pick(quality, 0.5).alias("quality"),
            pick(shares["hedging"], 0.0).alias("hedging"),
            pick(attribution, 0.0).alias("attribution"),
            pick(specificity, 0.0).alias("specificity"),
        )

    spoken = lambda s: F.length(F.regexp_replace(s, r"(?U)^\s+|\s+$", "")) > 10
    sentences = F.filter(F.split(sample, "[.!?]+"), spoken)
    return maps.let(maps.let(sentences, measure), judge)


def has_primary_document(text: Column, url: Column, size: int | None = 5000) -> Column:
    both = F.concat(
        T.opening(F.coalesce(text, F.lit("")), size), F.lit(" "), F.coalesce(url, F.lit(""))
    )
    return T.any_match(both, K.PRIMARY_DOCS)


def is_contradictory(text: Column, size: int | None = 2000) -> Column:
    return F.coalesce(T.matches(T.opening(F.lower(text), size), K.CONTRADICTIONS), F.lit(False))


def confirmation(any_official: Column, any_entity: Column, any_unattributed: Column) -> Column:
    """Struct: score, level; inputs are cluster-wide flags."""
    level = lambda s, n: F.struct(F.lit(s).alias("score"), F.lit(n).alias("level"))
    return (
        F.when(any_official, level(1.0, "official"))
        .when(any_entity, level(0.75, "attributed"))
        .when(any_unattributed, level(0.25, "unattributed"))
        .otherwise(level(0.05, "rumor"))
    )


def confirmation_flags(text: Column, url: Column, primary_entity: Column) -> dict[str, Column]:
    """Per-article flags that feed ``confirmation`` through bool_or."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    press = F.lit(False)
    for phrase in K.PRESS_PHRASES:
        press = press | F.contains(lowered, F.lit(phrase))
    quoted = F.regexp_replace(F.lower(primary_entity), r"([^\p{L}\p{N}_])", r"\\$1")
    says = F.regexp_like(lowered, F.concat(quoted, F.lit(r"\s+(?:said|confirmed|announced|stated)")))
    return {
        "official": U.is_official(url, K.CONFIRMING_DOMAINS) | press,
        "entity": F.coalesce(says, F.lit(False)),
        "unattributed": lowered.rlike(K.UNATTRIBUTED),
    }


def trust_score(
    corroborated: Column, confirmed: Column, source: Column, quality: Column, primary: Column, event: Column,
    hours_since_first: Column,
) -> Column:
    w = K.TRUST_WEIGHTS
    raw = (
        w["corroboration"] * corroborated
        + w["official_confirmation"] * confirmed
        + w["source_trust"] * source
        + w["claim_quality"] * quality
        + w["primary_document"] * F.when(primary, 1.0).otherwise(0.0)
    )
    score = maps.round_half_even(F.least(F.lit(100.0), raw * 100.0), 2)
    score = (
        F.when((event == "RESEARCH_PAPER") & primary, F.greatest(score, F.lit(65.0)))
        .when((event == "OPEN_SOURCE_RELEASE") & primary, F.greatest(score, F.lit(70.0)))
        .otherwise(score)
    )
    return F.when(hours_since_first < 2, maps.round_half_even(score * 0.90, 2)).otherwise(score)


def trust_label(
    score: Column, level: Column, independent: Column, hours_since_first: Column, contradictory: Column
) -> Column:
    developing = F.coalesce(hours_since_first < 6, F.lit(False))
    # A first report at the very moment of scoring (0 h) does not count as developing.
    developing = developing & (F.coalesce(hours_since_first, F.lit(0.0)) != 0)
    return (
        F.when(contradictory, "disputed")
        .when(level == "official", "official")
        .when((score >= 75) & (independent >= 3), "confirmed")
        .when((score >= 55) & (independent >= 2), "likely")
        .when(developing, "developing")
        .when((independent >= 2) & (score >= 40) & (level != "rumor"), "likely")
        .when(score < 40, "unverified")
        .otherwise("developing")
    )


# --- verification -----------------------------------------------------------------------------

def is_artifact(url: Column) -> Column:
    site = U.host(url)
    parts = F.filter(F.split(U.path(url), "/"), lambda s: s != "")
    first = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))
    return (
        F.when(
            site.isin(K.REPOSITORY_HOSTS),
            (F.size(parts) >= 2) & ~first.isin(K.REPOSITORY_PAGES),
        )
        .when(site == "huggingface.co", (F.size(parts) >= 2) & ~first.isin(K.MODEL_HUB_PAGES))
        .otherwise(site.isin(K.ARTIFACT_HOSTS))
    )


def verification_mode(url: Column, kind: Column) -> Column:
    site = U.host(url)
    return (
        F.when(site.isin(K.PREPRINT_HOSTS), "research_preprint")
        .when(site.isin(K.PUBLISHED_HOSTS), "research_published")
        .when(is_artifact(url), "artifact")
        .when(U.is_official(url), "official_statement")
        .when(kind.isin(K.COMMUNITY_KINDS) | site.isin(K.COMMUNITY_HOSTS), "community_post")
        .otherwise("reported_news")
    )


def freshness_state(age: Column) -> Column:
    return F.when(age < 6, "fresh").when(age < 24, "maturing").otherwise("stable")


def update_status(text: Column, size: int | None = 400) -> Column:
    sample = T.opening(F.lower(F.coalesce(text, F.lit(""))), size)
    return (
        F.when(T.any_match(sample, K.RETRACTIONS), "retracted")
        .when(T.any_match(sample, K.CORRECTIONS), "corrected")
        .otherwise("active")
    )


def _contains_any(text: Column, patterns: list[str], size: int | None = 5000) -> Column:
    return T.any_match(T.opening(F.lower(F.coalesce(text, F.lit(""))), size), patterns)


def verification_signals(mode: Column, url: Column, text: Column, kind: Column, authority: Column, independent: Column) -> Column:
    """Struct of the parts (0..1) that the mode's confidence is made of, unused parts null."""
    site = U.host(url)
    official, auth = U.is_official(url), S.clamp(authority)
    support = S.corroboration(independent)
    announces = _contains_any(text, K.ANNOUNCEMENTS)
    anonymous, direct = _contains_any(text, K.ANONYMOUS_SOURCES), _contains_any(text, K.DIRECT_EVIDENCE)
    artifact, statement = mode == "artifact", mode == "official_statement"
    preprint, published = mode == "research_preprint", mode == "research_published"
    research, news = preprint | published, mode == "reported_news"
    community = ~(artifact | statement | research | news)
    integrity = F.when(
        F.contains(U.path(url), F.lit("/releases")) | site.isin(K.PACKAGE_HOSTS), 0.85
    ).otherwise(0.68)
    integrity = F.when(site == "huggingface.co", F.greatest(integrity, F.lit(0.75))).otherwise(integrity)
    return F.struct(
        F.when(artifact, F.when(official, 1.0).otherwise(F.greatest(F.lit(0.68), auth * 0.9 + 0.15)))
        .when(statement, F.when(official, 1.0).otherwise(auth))
        .when(preprint, 0.68)
        .when(published, 0.78)
        .when(news | community, auth)
        .alias("identity"),
        F.when(artifact | research, 1.0)
        .when(statement, F.when(announces, 0.92).otherwise(0.76))
        .when(news, F.when(anonymous & ~direct, 0.35).when(direct, 0.8).otherwise(0.55))
        .when(community, F.when(site.isin(K.COMMUNITY_HOSTS), 0.15).otherwise(0.45))
        .alias("evidence"),
        F.when(artifact, integrity).alias("integrity"),
        F.when(research, F.when(_contains_any(text, K.RESEARCH_ARTIFACTS), 0.75).otherwise(0.45)).alias("supporting"),
        F.when(artifact, F.when(direct | announces, F.lit(0.75 + 0.15)).otherwise(0.75))
        .when(statement, F.when(announces, 0.88).otherwise(0.72))
        .when(research, F.when(_contains_any(text, K.RESEARCH_WORDS), 0.78).otherwise(0.62))
        .when(news, F.when(_contains_any(text, K.VERIFIED_SPECIFICS), 0.78).otherwise(0.62))
        .alias("alignment"),
        F.when(news, F.when(anonymous, 0.35).otherwise(0.8)).alias("attribution"),
        F.when(community, support * 0.6).otherwise(support).alias("corroboration"),
        F.when(community, F.when(kind.isin(K.COMMUNITY_KINDS), 0.25).otherwise(0.4)).alias("provenance"),
        F.when(news, F.when(_contains_any(text, K.DISPUTES), 1.0).otherwise(0.0))
        .when(community, F.when(anonymous, 0.25).otherwise(0.0))
        .alias("contradiction_penalty"),
        F.when(statement | research, 1.0).alias("update"),
    )


def verification_confidence(mode: Column, parts: Column) -> Column:
    """Weighted sum per mode, on 0..100."""
    p = parts
    preprint = 0.20 * p["identity"] + 0.25 * p["evidence"] + 0.15 * p["supporting"] + 0.15 * p["alignment"] \
        + 0.10 * p["corroboration"] + 0.15 * p["update"]
    published = 0.20 * p["identity"] + 0.20 * p["evidence"] + 0.15 * p["supporting"] + 0.15 * p["alignment"] \
        + 0.15 * p["corroboration"] + 0.15 * p["update"]
    artifact = 0.30 * p["identity"] + 0.35 * p["evidence"] + 0.20 * p["integrity"] \
        + 0.10 * S.clamp(p["alignment"]) + 0.05 * p["corroboration"]
    statement = 0.35 * p["identity"] + 0.30 * p["evidence"] + 0.20 * p["alignment"] \
        + 0.10 * p["corroboration"] + 0.05 * p["update"]
    news = 0.25 * p["attribution"] + 0.25 * p["evidence"] + 0.25 * p["corroboration"] + 0.10 * p["identity"] \
        + 0.10 * p["alignment"] + 0.05 * (1.0 - p["contradiction_penalty"])
    community = 0.20 * p["identity"] + 0.35 * p["evidence"] + 0.20 * p["corroboration"] \
        + 0.10 * p["provenance"] + 0.15 * (1.0 - p["contradiction_penalty"])
    return (
        F.when(mode == "artifact", 100.0 * artifact)
        .when(mode == "official_statement", 100.0 * statement)
        .when(mode == "research_preprint", F.least(100.0 * preprint, F.lit(79.0)))
        .when(mode == "research_published", 100.0 * published)
        .when(mode == "reported_news", 100.0 * news)
        .otherwise(F.least(100.0 * community, F.lit(69.0)))
    )


def verification_state(mode: Column, confidence: Column, independent: Column, text: Column) -> Column:
    """Struct: state, confidence (after corrections and disputes), update_status."""
    disputed, status = _contains_any(text, K.DISPUTES), update_status(text)
    by_mode = (
        F.when(mode == "artifact", F.when(confidence >= 60, "verified_artifact").otherwise("community_signal"))
        .when(mode == "official_statement", "official_statement")
        .when(mode == "research_preprint", F.when(confidence >= 60, "verified_artifact").otherwise("single_source_report"))
        .when(mode == "research_published", F.when(confidence >= 65, "verified_artifact").otherwise("single_source_report"))
        .when(
            mode == "reported_news",
            F.when((independent >= 2) & (confidence >= 65), "corroborated_report").otherwise("single_source_report"),
        )
        .otherwise("community_signal")
    )
    fixed = status != "active"
    return F.struct(
        F.when(fixed, "corrected_or_retracted").when(disputed, "disputed").otherwise(by_mode).alias("state"),
        maps.round_half_even(
            F.when(status == "retracted", F.least(confidence, F.lit(30.0)))
            .when(status == "corrected", F.least(confidence, F.lit(40.0)))
            .when(disputed, F.least(confidence, F.lit(35.0)))
            .otherwise(confidence),
            2,
        ).alias("confidence"),
        status.alias("update_status"),
    )


def label_for_state(state: Column, confidence: Column) -> Column:
    sure = F.coalesce(confidence, F.lit(0.0))
    return (
        F.when(state == "verified_artifact", F.when(sure >= 75, "confirmed").otherwise("likely"))
        .when(state == "single_source_report", F.when(sure >= 70, "likely").otherwise("unverified"))
        .when(state == "official_statement", "official")
        .when(state == "corroborated_report", "confirmed")
        .when(state == "community_signal", "unverified")
        .when(state.isin("disputed", "corrected_or_retracted"), "disputed")
    )


def trust_components(mode: Column, state: Column, parts: Column, text: Column, size: int | None = 5000) -> Column:
    """Struct of display components derived from the verification result."""
    level = (
        F.when(state == "official_statement", "official")
        .when(state.isin("verified_artifact", "corroborated_report"), "attributed")
        .otherwise("rumor")
    )
    tenth = lambda c: maps.round_half_even(maps.round_half_even(c * 100.0, 1), 1)
    sample = T.opening(F.lower(F.coalesce(text, F.lit(""))), size)
    sentences = F.greatest(
        F.lit(1), F.size(F.filter(F.split(sample, "[.!?]+"), lambda s: F.regexp_replace(s, r"(?U)\s+", "") != ""))
    )
    ratio = lambda patterns: maps.round_half_even(
        F.least(F.lit(1.0), T.count_matching(sample, patterns) / sentences), 3
    )
    community = mode == "community_post"
    # The community breakdown carries no claim signal, so its claim quality reads 0.
    return F.struct(
        tenth(parts["corroboration"]).alias("corroboration"),
        F.when(level == "official", 100.0).when(level == "attributed", 65.0).otherwise(15.0).alias("official_confirmation"),
        tenth(parts["identity"]).alias("source_trust"),
        F.when(community, 0.0).otherwise(tenth(parts["alignment"])).alias("claim_quality"),
        F.when(
            mode.isin("artifact", "research_preprint", "research_published", "official_statement"), 100.0
        ).otherwise(0.0).alias("primary_document"),
        level.alias("confirmation_level"),
        ratio(K.ANONYMOUS_SOURCES).alias("hedging_ratio"),
        ratio(K.DIRECT_EVIDENCE).alias("attribution_ratio"),
        maps.round_half_even(F.least(F.lit(1.0), T.count_matching(sample, K.VERIFIED_SPECIFICS) / 3.0), 3).alias("specificity_score"),
    )


def cluster_trust(
    stored: Column, stored_label: Column, top_trust: Column, top_label: Column, independent: Column, age: Column
) -> Column:
    """Struct: trust, label.  A stored confidence wins; else the top article's trust with a boost."""
    boosted = F.least(
        F.lit(100.0),
        F.coalesce(top_trust, F.lit(0.0)) + F.when(F.coalesce(independent, F.lit(0)) >= 3, 10.0).otherwise(0.0),
    )
    n = F.coalesce(independent, F.lit(0))
    derived = (
        F.when(top_label.isin("disputed", "official"), top_label)
        .when((boosted >= 75) & (n >= 3), "confirmed")
        .when((boosted >= 55) & (n >= 2), "likely")
        .when(F.coalesce(age, F.lit(0.0)) < 6, "developing")
        .when(boosted < 40, "unverified")
        .otherwise(F.coalesce(top_label, F.lit("unverified")))
    )
    return F.struct(
        F.coalesce(stored, boosted).alias("trust"),
        F.when(stored.isNotNull(), F.coalesce(stored_label, top_label, F.lit("unverified")))
        .otherwise(derived)
        .alias("label"),
    )
