"""URL expressions.  Split by pattern: malformed URLs give empty parts and never raise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsgraph import constants as K

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, n)


def netloc(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def host(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", ""))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def segments(url: Column) -> Column:
    return F.filter(F.split(F.lower(path(url)), "/"), lambda s: s != "")


def _form_decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _form_encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_key(url: Column) -> Column:
    """Key for matching one story across sources: no scheme, fragment, www, tracking or trailing slash."""
    trimmed = F.trim(F.coalesce(url, F.lit("")))
    site = F.regexp_replace(F.lower(netloc(trimmed)), r"^www\.", "")
    raw_path = F.regexp_replace(path(trimmed), r";[^/]*$", "")
    trimmed_path = F.regexp_replace(raw_path, r"/+$", "")
    clean_path = F.when(raw_path.isin("", "/"), F.lit("/")).otherwise(trimmed_path)
    pairs = F.transform(
        F.filter(F.split(_part(trimmed, 4), "&"), lambda p: F.length(F.substring_index(p, "=", 1)) < F.length(p) - 1),
        lambda p: F.struct(
            _form_decode(F.substring_index(p, "=", 1)).alias("k"),
            _form_decode(F.regexp_replace(p, r"^[^=]*=", "")).alias("v"),
        ),
    )
    kept = F.array_sort(
        F.filter(
            pairs,
            lambda p: ~(F.startswith(F.lower(p["k"]), F.lit("utm_")) | F.lower(p["k"]).isin(K.TRACKING_QUERY_KEYS)),
        )
    )
    query = F.array_join(
        F.transform(kept, lambda p: F.concat(_form_encode(p["k"]), F.lit("="), _form_encode(p["v"]))), "&"
    )
    return F.when(trimmed == "", F.lit("")).otherwise(
        F.concat(
            F.when(site != "", F.concat(F.lit("//"), site)).otherwise(F.lit("")),
            clean_path,
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        )
    )


def is_evergreen(url: Column) -> Column:
    """Directory, section index or evergreen page rather than a story."""
    parts = segments(url)
    depth = F.size(parts)
    first, last = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(-1))
    second = F.try_element_at(parts, F.lit(2))
    words = lambda values: F.array(*[F.lit(v) for v in values])
    return (
        url.isNull()
        | (netloc(url) == "")
        | (depth == 0)
        | F.arrays_overlap(parts, words(K.EVERGREEN_SEGMENTS))
        | ((depth == 1) & first.isin(K.LOCALE_PREFIXES))
        | ((depth == 2) & first.isin(K.LOCALE_PREFIXES) & second.isin(K.SECTION_SLUGS))
        | ((depth <= 2) & last.isin(K.SECTION_SLUGS))
    )


def is_news_candidate(url: Column, path_filter: str | None = None) -> Column:
    ok = url.isNotNull() & (url != "") & ~is_evergreen(url)
    return ok & F.contains(url, F.lit(path_filter)) if path_filter else ok


def in_domains(url: Column, domains: list[str]) -> Column:
    """Host equals one of the domains or lies below it."""
    site = host(url)
    hit = site.isin(domains)
    for domain in domains:
        hit = hit | F.endswith(site, F.lit("." + domain))
    return hit


def is_official(url: Column, domains: list[str] | None = None) -> Column:
    return F.coalesce(in_domains(url, domains or K.OFFICIAL_DOMAINS), F.lit(False))
