"""SQL text shared by the check statements: the stand-in model and small expression builders."""

from __future__ import annotations

from newsgraph import constants as K
from newsgraph.sources import standin as D


def q(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def arr(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def lst(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def pick(values, index: str) -> str:
    return f"({arr(values)})[1 + CAST(({index}) % {len(values)} AS INTEGER)]"


def lookup(values: dict, key: str, default: str | None = None) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in values.items())
    return f"(CASE {key} {whens} ELSE {default or 'NULL'} END)"


def has(text: str, pattern: str) -> str:
    """Case-insensitive pattern search."""
    return f"regexp_matches({text}, {q(pattern)}, 'i')"


def has_any(text: str, patterns) -> str:
    return has(text, "(?:" + "|".join(patterns) + ")")


def n_has(text: str, patterns) -> str:
    return "(" + " + ".join(f"CAST({has(text, p)} AS INTEGER)" for p in patterns) + ")"


def clamp(x: str, lo="0.0", hi="1.0") -> str:
    return f"greatest({lo}, least({hi}, {x}))"


def log_share(v: str, top: float) -> str:
    return f"(CASE WHEN coalesce({v}, 0) <= 0 THEN 0.0 ELSE {clamp(f'ln(1 + {v}::DOUBLE) / ln(1 + {top}::DOUBLE)')} END)"


def hours(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 3.6e9)"


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def path(url: str) -> str:
    return f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def official(url: str, domains=K.OFFICIAL_DOMAINS) -> str:
    return "(" + " OR ".join(
        f"{host(url)} = {q(d)} OR {host(url)} LIKE {q('%.' + d)}" for d in domains
    ) + ")"


_N = "CAST(regexp_extract(d.source, '([0-9]+)$', 1) AS BIGINT)"
_KIND = pick(D.KINDS, _N)
_EVENT = lookup(D.EVENT_OF, "e.event_type")

ARTICLES = f"""
articles AS (
  SELECT d.doc_id AS article_id, d.source AS source_name, {_N} AS source_no, {_KIND} AS source_kind,
    (({_N} * 37) % 100) / 100.0::DOUBLE AS authority,
    coalesce(p.url, 'https://' || {pick(D.HOSTS, 'd.doc_id')} || {pick(D.PATHS, 'd.doc_id')} || d.doc_id) AS final_url,
    {_EVENT} AS event_type,
    CASE WHEN {_KIND} = 'github' THEN 'github' WHEN {_KIND} = 'arxiv' THEN 'research' ELSE 'news' END AS content_type,
    CASE WHEN d.doc_id % 17 <> 0 THEN e.ts END AS published_at,
    e.ts + to_minutes(d.doc_id % 180) AS fetched_at,
    e.ts + to_minutes(d.doc_id % 180 + 10) AS created_at,
    CASE WHEN {_KIND} = 'hn' THEN e.points END AS hn_points,
    CASE WHEN {_KIND} = 'reddit' THEN e.points END AS reddit_upvotes,
    CASE WHEN {_KIND} = 'github' THEN e.points END AS github_stars,
    ((d.doc_id * 7919) % 10000) / 100.0::DOUBLE AS global_score,
    CASE WHEN d.doc_id % 4 <> 0 THEN ((d.doc_id * 104729) % 10000) / 100.0::DOUBLE END AS final_score,
    ((d.doc_id * 31) % 1000) / 10.0::DOUBLE AS trust_score,
    {pick(["official", "confirmed", "likely", "developing", "unverified", "disputed"], 'd.doc_id')} AS trust_label,
    CASE WHEN d.doc_id % 19 <> 0 THEN e.user_id END AS cluster_id,
    {pick(D.LEADS, 'd.doc_id')} || ' ' || split_part(d.text, chr(10), 1) AS title,
    {pick(D.OPENINGS, 'd.doc_id')} || ' ' || d.text AS text
  FROM documents d JOIN (SELECT event_id // 10 AS doc_id, min(ts) AS ts, arg_min(user_id, event_id) AS user_id, arg_max(event_type, event_id) AS event_type,
    CAST(sum(CAST(round(value * 10) AS BIGINT)) AS INTEGER) AS points FROM events GROUP BY 1) e ON e.doc_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id
)"""

TOPIC_ROWS = f"""
topic_rows AS (
  SELECT doc_id AS article_id, {pick(K.TOPICS, 'doc_id')} AS topic, (40 + (doc_id % 5) * 5) / 100.0::DOUBLE AS weight
  FROM documents WHERE doc_id % 11 <> 0
  UNION ALL
  SELECT doc_id, {pick(K.TOPICS, 'doc_id + 3')}, (30 - (doc_id % 3) * 5) / 100.0::DOUBLE FROM documents WHERE doc_id % 11 <> 0
  UNION ALL
  SELECT doc_id, {pick(K.TOPICS, 'doc_id + 7')}, 0.1::DOUBLE FROM documents WHERE doc_id % 11 <> 0
)"""

ENTITY_ROWS = f"""
entity_rows AS (
  SELECT doc_id AS article_id, {pick(D.NAMES, 'doc_id * 7')} AS entity, 0.5::DOUBLE AS weight FROM documents WHERE doc_id % 13 <> 0
  UNION ALL
  SELECT doc_id, {pick(D.NAMES, 'doc_id * 7 + 5')}, 0.3::DOUBLE FROM documents WHERE doc_id % 13 <> 0
  UNION ALL
  SELECT doc_id, {pick(D.NAMES, 'doc_id * 7 + 11')}, 0.2::DOUBLE FROM documents WHERE doc_id % 13 <> 0
)"""

SOURCES = f"""
sources AS (
  SELECT source AS source_name, {pick(D.KINDS, "n")} AS source_kind, ((n * 37) % 100) / 100.0::DOUBLE AS authority,
    n % 7 = 0 AS always_scrape
  FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS n FROM documents)
)"""

AS_OF = "as_of AS (SELECT max(ts) AS now FROM events)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"
