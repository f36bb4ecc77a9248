"""F1-F37: text, URL, feature and display expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgraph import constants as K
from newsgraph.catalog import sqlbase as B
from newsgraph.functions import cards as CD, features as FT, maps, scoring as S, text as T, trust as TR, urls as U
from newsgraph.sources import standin as D
from newsgraph.sources.tables import as_of, spread, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


c = F.col
A = B.with_(B.ARTICLES)

_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def sql_ws(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {B.q(_WS)}, ' ', 'g'))"


@query("f01_whitespace", f"SELECT doc_id, md5({sql_ws('text')}) AS clean_md5, length({sql_ws('text')}) AS n FROM documents")
def f01(spark, sf):
    clean = T.collapse_ws(c("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(clean).alias("clean_md5"), F.length(clean).alias("n")
    )


_GONE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', chr(1), 'g'), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', chr(1), 'g'), '</?[A-Za-z!][^>]*>', chr(1), 'g')"
for _e, _ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _GONE = f"replace({_GONE}, '{_e}', '{_ch}')"
_PLAIN = (
    f"replace(regexp_replace(regexp_replace({_GONE}, '[\\s\\x{{01}}\\x{{a0}}]*\\x{{01}}[\\s\\x{{01}}\\x{{a0}}]*', chr(1), 'g'), "
    f"'^[\\s\\x{{01}}]+|[\\s\\x{{01}}]+$', '', 'g'), chr(1), ' ')"
)


@query("f02_strip_html", f"SELECT page_id, md5({_PLAIN}) AS plain_md5, length({_PLAIN}) AS n FROM pages")
def f02(spark, sf):
    plain = T.strip_html(c("html"))
    return table(spark, sf, "pages").select("page_id", F.md5(plain).alias("plain_md5"), F.length(plain).alias("n"))


@query(
    "f03_canonical_hash",
    A + "SELECT article_id, sha256(lower(trim(title, chr(32)||chr(9)||chr(10)||chr(13))) || chr(10) || lower(trim(final_url))) AS hash FROM articles",
)
def f03(spark, sf):
    return D.articles(spark, sf, text="title").select("article_id", T.canonical_hash(c("title"), c("final_url")).alias("hash"))


_PAIRS = (
    "list_sort(list_filter(list_filter(string_split(regexp_extract({u}, '[?]([^#]*)', 1), '&'), lambda p: contains(p, '=') "
    "AND split_part(p, '=', 2) <> ''), lambda p: NOT starts_with(lower(p), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN "
    + B.lst(K.TRACKING_QUERY_KEYS)
    + "))"
)


def sql_key(u: str) -> str:
    pairs = f"array_to_string({_PAIRS.format(u=u)}, '&')"
    p = f"CASE WHEN {B.path(u)} IN ('', '/') THEN '/' ELSE regexp_replace({B.path(u)}, '/+$', '') END"
    return (
        f"('//' || regexp_replace({B.host(u)}, '^www\\.', '') || {p} || "
        f"CASE WHEN {pairs} <> '' THEN '?' || {pairs} ELSE '' END)"
    )


@query("f04_url_key", f"SELECT page_id, {sql_key('url')} AS url_key FROM pages")
def f04(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.url_key(c("url")).alias("url_key"))


def sql_evergreen(u: str) -> str:
    s = f"list_filter(string_split(lower({B.path(u)}), '/'), lambda s: s <> '')"
    return (
        f"({u} IS NULL OR {B.host(u)} = '' OR len({s}) = 0 OR list_has_any({s}, {B.arr(K.EVERGREEN_SEGMENTS)}) "
        f"OR (len({s}) = 1 AND {s}[1] IN {B.lst(K.LOCALE_PREFIXES)}) "
        f"OR (len({s}) = 2 AND {s}[1] IN {B.lst(K.LOCALE_PREFIXES)} AND {s}[2] IN {B.lst(K.SECTION_SLUGS)}) "
        f"OR (len({s}) <= 2 AND {s}[len({s})] IN {B.lst(K.SECTION_SLUGS)}))"
    )


@query(
    "f05_evergreen_url",
    f"SELECT page_id, cut, {sql_evergreen('u')} AS evergreen FROM (SELECT page_id, cut, CASE cut WHEN 0 THEN url "
    "WHEN 1 THEN regexp_replace(url, '/[^/]*$', '') WHEN 2 THEN regexp_replace(url, '[0-9]+.*$', 'news') "
    "ELSE regexp_replace(url, '[0-9]+.*$', 'about/team') END AS u FROM pages, (SELECT unnest([0, 1, 2, 3]) AS cut))",
)
def f05(spark, sf):
    forms = F.array(
        c("url"),
        F.regexp_replace("url", "/[^/]*$", ""),
        F.regexp_replace("url", "[0-9]+.*$", "news"),
        F.regexp_replace("url", "[0-9]+.*$", "about/team"),
    )
    return (
        table(spark, sf, "pages")
        .select("page_id", F.posexplode(forms).alias("cut", "u"))
        .select("page_id", "cut", U.is_evergreen(c("u")).alias("evergreen"))
    )


@query(
    "f06_news_candidate_url",
    f"SELECT page_id, contains(url, '/en/') AND NOT {sql_evergreen('url')} AS candidate FROM pages",
)
def f06(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.is_news_candidate(c("url"), "/en/").alias("candidate"))


@query(
    "f07_content_type",
    A + "SELECT source_kind, event_type, CASE WHEN source_kind IN ('github', 'github_trending') THEN 'github' "
    "WHEN source_kind = 'arxiv' OR event_type = 'RESEARCH_PAPER' THEN 'research' ELSE 'news' END AS content_type, "
    "count(*) AS n FROM articles GROUP BY ALL",
)
def f07(spark, sf):
    kind = FT.content_type(c("source_kind"), c("event_type"))
    return D.articles(spark, sf, text=False).groupBy("source_kind", "event_type", kind.alias("content_type")).agg(
        F.count("*").alias("n")
    )


_SQL_EVENT = "CASE WHEN source_kind = 'arxiv' THEN 'RESEARCH_PAPER' WHEN source_kind = 'nvd' THEN 'SECURITY_INCIDENT' " + " ".join(
    f"WHEN {B.has('title', p)} THEN {B.q(n)}" for n, p in K.EVENT_RULES
) + " ELSE 'OTHER' END"


@query("f08_event_type", A + f"SELECT article_id, {_SQL_EVENT} AS event_type FROM articles")
def f08(spark, sf):
    return D.articles(spark, sf, text="title").select("article_id", FT.event_type(c("title"), c("source_kind")).alias("event_type"))


def sql_amount(x: str) -> str:
    n = f"regexp_extract_all({x}, {B.q(K.AMOUNT_PATTERN)}, 1)"
    u = f"regexp_extract_all({x}, {B.q(K.AMOUNT_PATTERN)}, 2)"
    return (
        f"list_max(list_transform(list_zip({n}, {u}), lambda z: CAST(trunc(CAST(replace(z[1], ',', '') AS DOUBLE) * "
        "CASE lower(z[2]) WHEN 'b' THEN 1e9 WHEN 'm' THEN 1e6 WHEN 'k' THEN 1e3 ELSE 1.0 END) AS BIGINT)))"
    )


@query("f09_funding_amount", A + f"SELECT article_id, {sql_amount('title || chr(10) || text')} AS amount FROM articles")
def f09(spark, sf):
    text = F.concat(c("title"), F.lit("\n"), c("text"))
    return D.articles(spark, sf).select("article_id", T.funding_amount(text).alias("amount"))


@query("f10_official_url", A + f"SELECT article_id, {B.official('final_url')} AS official FROM articles")
def f10(spark, sf):
    return D.articles(spark, sf, text=False).select("article_id", U.is_official(c("final_url")).alias("official"))


_SQL_OWNER = "CASE " + " ".join(
    f"WHEN {B.host('final_url')} = {B.q(d)} OR {B.host('final_url')} LIKE {B.q('%.' + d)} THEN {B.q(e)}"
    for d, e in K.SOURCE_ENTITY_BY_DOMAIN.items()
) + " " + " ".join(
    f"WHEN contains(lower(label), {B.q(h.lower())}) THEN {B.q(e)}" for h, e in K.SOURCE_ENTITY_BY_NAME.items()
) + " END"


@query(
    "f11_source_entity",
    A + f"SELECT article_id, {_SQL_OWNER} AS owner FROM (SELECT *, {B.pick(D.NAMES, 'article_id')} || ' Blog' AS label FROM articles)",
)
def f11(spark, sf):
    label = F.concat(D.pick(D.NAMES, c("article_id")), F.lit(" Blog"))
    return D.articles(spark, sf, text=False).select("article_id", FT.source_entity(label, c("final_url")).alias("owner"))


_NEAR = "concat_ws(' ', nullif(title, ''), nullif(final_url, ''), nullif(substr(text, 1, 400), ''))"
_WIDE = "concat_ws(' ', nullif(title, ''), nullif(substr(text, 1, 1200), ''), nullif(final_url, ''))"
_ART = "trim(regexp_replace(coalesce(" + ", ".join(
    f"nullif(regexp_extract(near, {B.q(p)}, 1), '')" for p in K.ARTIFACT_NAME_PATTERNS
) + "), '\\s+', ' ', 'g'))"
_F12 = A + f"""
, base AS (SELECT *, {_NEAR} AS near, {_WIDE} AS wide FROM articles),
hits AS (SELECT article_id, {B.official('final_url')} AS official, {_ART} AS artifact,
  {B.n_has('wide', K.RELEASE_FRAMING)} AS r, {B.n_has('wide', K.MODEL_CAPABILITY)} AS m,
  {B.n_has('wide', K.SYSTEM_CARD)} AS s, {B.n_has('wide', K.NON_RELEASE)} AS x FROM base),
scored AS (SELECT *, (CASE WHEN official THEN 3 ELSE 0 END) + (CASE WHEN artifact IS NOT NULL THEN 3 ELSE 0 END)
  + (CASE WHEN r > 0 THEN 2 ELSE 0 END) + (CASE WHEN m >= 2 THEN 2 WHEN m = 1 THEN 1 ELSE 0 END)
  + (CASE WHEN s > 0 THEN 2 ELSE 0 END) - (CASE WHEN x > 0 AND artifact IS NULL THEN 2 ELSE 0 END) AS evidence FROM hits)
SELECT article_id, official AND artifact IS NOT NULL AND (s > 0 OR (r >= 1 AND m >= 2) OR (r >= 2 AND m >= 1)) AS is_release,
  artifact AS artifact_name, evidence, {B.clamp('evidence / 10.0')} AS confidence FROM scored"""


@query("f12_official_release", _F12)
def f12(spark, sf):
    found = FT.release_assessment(c("title"), c("text"), c("final_url"), c("source_name"))
    return D.articles(spark, sf).select("article_id", found.alias("a")).select(
        "article_id", "a.is_release", "a.artifact_name", "a.evidence", "a.confidence"
    )


def sql_bucket(w: str) -> str:
    h = f"sha256({w})"
    return (
        f"CAST((('0x' || substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2))::BIGINT % 384) AS INTEGER)"
    )


def sql_sparse(source: str, key: str, text: str, name: str) -> str:
    return f"""
{name}_w AS (SELECT {key} AS id, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS word FROM {source}),
{name}_c AS (SELECT id, bucket, sum(n) AS n FROM (SELECT id, {sql_bucket('word')} AS bucket, n FROM
  (SELECT id, word, count(*) AS n FROM {name}_w GROUP BY ALL)) GROUP BY ALL),
{name} AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS weight FROM {name}_c)"""


@query(
    "f13_word_vectors",
    B.with_(sql_sparse("documents", "doc_id", "text", "v")) + "SELECT id AS doc_id, bucket, round(weight, 6) AS weight FROM v",
)
def f13(spark, sf):
    return FT.word_vectors(spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text").select(
        "doc_id", "bucket", F.round("weight", 6).alias("weight")
    )


_ANCHORS = "anchors AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {B.q(t)}, {B.q(p)})"
    for i, (t, p) in enumerate((t, p) for t, ps in K.TOPIC_ANCHORS.items() for p in ps)
) + ") AS t(id, topic, phrase))"


def sql_anchor_sims(source: str, key: str, text: str) -> list[str]:
    """CTEs giving sims(id, topic, sim): the best anchor similarity per topic, 0 where nothing is shared."""
    return [
        _ANCHORS,
        sql_sparse("anchors", "id", "phrase", "av"),
        sql_sparse(source, key, text, "tv"),
        f"""dots AS (SELECT tv.id, av.id AS a, sum(tv.weight * av.weight) AS sim FROM tv JOIN av USING (bucket) GROUP BY ALL),
best AS (SELECT d.id, x.topic, max(d.sim) AS sim FROM dots d JOIN anchors x ON x.id = d.a GROUP BY ALL),
sims AS (SELECT s.{key} AS id, t.topic, coalesce(b.sim, 0.0) AS sim FROM {source} s
  CROSS JOIN (SELECT DISTINCT topic FROM anchors) t LEFT JOIN best b ON b.id = s.{key} AND b.topic = t.topic)""",
    ]


@query(
    "f14_cosine",
    f"""{B.with_(_ANCHORS, B.ARTICLES, sql_sparse('anchors', 'id', 'phrase', 'av'), sql_sparse('articles', 'article_id', 'title', 'tv'))}
SELECT tv.id AS article_id, p.topic, p.phrase, round(sum(tv.weight * av.weight), 6) AS cosine
FROM tv JOIN av USING (bucket) JOIN anchors p ON p.id = av.id GROUP BY ALL""",
)
def f14(spark, sf):
    rows = [
        (topic, phrase, bucket, weight)
        for (topic, weights), (_t, phrase) in zip(
            FT._anchor_rows(), ((t, p) for t, ps in K.TOPIC_ANCHORS.items() for p in ps)
        )
        for bucket, weight in weights.items()
    ]
    anchors = spark.createDataFrame(rows, "topic string, phrase string, bucket int, anchor_weight double")
    vectors = FT.word_vectors(D.articles(spark, sf, text="title"), "article_id", "title")
    return (
        vectors.join(F.broadcast(anchors), "bucket")
        .groupBy("article_id", "topic", "phrase")
        .agg(F.round(F.sum(c("weight") * c("anchor_weight")), 6).alias("cosine"))
    )


_TOPIC_TEXT = "SELECT article_id, title || chr(10) || substr(text, 1, 1000) AS t FROM articles"
_SOFTMAX = """probs AS (SELECT id, topic, exp(sim / 0.07 - max(sim) OVER (PARTITION BY id)) AS e FROM sims),
dist AS (SELECT id AS article_id, topic, e / sum(e) OVER (PARTITION BY id) AS prob FROM probs)"""
TOPIC_DIST = [B.ARTICLES, f"tt AS ({_TOPIC_TEXT})", *sql_anchor_sims("tt", "article_id", "t"), _SOFTMAX]


def with_topics(df):
    text = F.concat(c("title"), F.lit("\n"), F.substring("text", 1, 1000))
    return FT.with_anchor_similarity(df, text, "sims").withColumn("topic_dist", FT.topic_distribution(c("sims"))).drop("sims")


@query("f15_topic_distribution", B.with_(*TOPIC_DIST) + "SELECT article_id, topic, round(prob, 6) AS prob FROM dist")
def f15(spark, sf):
    return (
        with_topics(D.articles(spark, sf).select("article_id", "title", "text"))
        .select("article_id", F.explode_outer("topic_dist").alias("topic", "p"))
        .select("article_id", "topic", F.round("p", 6).alias("prob"))
    )


@query(
    "f16_release_topics",
    B.with_(B.TOPIC_ROWS) + """
, full_rows AS (SELECT article_id, topic, weight FROM topic_rows UNION ALL
  SELECT DISTINCT article_id, 'llms', 0.0 FROM topic_rows WHERE article_id NOT IN (SELECT article_id FROM topic_rows WHERE topic = 'llms')),
rest AS (SELECT article_id, sum(weight) FILTER (topic <> 'llms') AS rest FROM full_rows GROUP BY 1),
boosted AS (SELECT f.article_id, topic, CASE WHEN topic = 'llms' THEN greatest(weight, 0.72) ELSE 0.28 * weight / rest END AS w
  FROM full_rows f JOIN rest r USING (article_id))
SELECT article_id, topic, round(w / sum(w) OVER (PARTITION BY article_id), 6) AS weight FROM boosted""",
)
def f16(spark, sf):
    return (
        D.article_tags(spark, sf)
        .filter(F.size("topics") > 0)
        .select("article_id", F.explode(FT.boost_release_topics(c("topics"))).alias("topic", "w"))
        .select("article_id", "topic", F.round("w", 6).alias("weight"))
    )


@query(
    "f17_merge_source_entity",
    B.with_(B.ENTITY_ROWS, f"own AS (SELECT doc_id AS article_id, {B.pick(D.NAMES, 'doc_id')} AS e, doc_id % 2 = 0 AS promote FROM documents)")
    + """, ents AS (SELECT article_id, entity, weight FROM entity_rows),
has_own AS (SELECT o.*, EXISTS (SELECT 1 FROM ents x WHERE x.article_id = o.article_id) AS any_ent,
  EXISTS (SELECT 1 FROM ents x WHERE x.article_id = o.article_id AND x.entity = o.e) AS present FROM own o),
merged AS (
  SELECT x.article_id, x.entity, CASE WHEN x.entity = h.e AND h.promote THEN greatest(x.weight, 0.85) ELSE x.weight END AS w,
    h.present AND NOT h.promote AS keep FROM ents x JOIN has_own h USING (article_id)
  UNION ALL
  SELECT article_id, e, CASE WHEN NOT any_ent THEN 1.0 WHEN promote THEN 0.85 ELSE 0.55 END, NOT any_ent FROM has_own WHERE NOT present)
SELECT article_id, entity, round(CASE WHEN keep THEN w ELSE w / sum(w) OVER (PARTITION BY article_id) END, 6) AS weight FROM merged""",
)
def f17(spark, sf):
    merged = FT.merge_source_entity(
        c("entities"), D.pick(D.NAMES, c("article_id")), F.pmod(c("article_id"), F.lit(2)) == 0
    )
    return (
        D.article_tags(spark, sf)
        .select("article_id", F.explode(merged).alias("entity", "w"))
        .select("article_id", "entity", F.round("w", 6).alias("weight"))
    )


_ALIAS = "aliases AS (SELECT * FROM (VALUES " + ", ".join(
    f"({B.q(a)}, {B.q(n)})" for a, n in sorted({(a.lower(), n) for n, names in K.ENTITY_ALIASES.items() for a in names})
) + ") AS t(alias, canonical))"


_FIRST = B.arr(sorted({a.lower().split(" ")[0] for names in K.ENTITY_ALIASES.values() for a in names}))


def sql_mentions(source: str, key: str, text: str) -> list[str]:
    return [
        _ALIAS,
        f"""toks AS (SELECT {key} AS id, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}#&]+') AS t FROM {source}),
runs AS (SELECT id, array_to_string(list_slice(t, pos, pos + size - 1), ' ') AS alias FROM
  (SELECT id, t, size, unnest(list_filter(range(1, len(t) - size + 2), lambda x: list_contains({_FIRST}, t[x]))) AS pos FROM toks, (SELECT DISTINCT len(string_split(alias, ' ')) AS size FROM aliases))),
counts AS (SELECT id, canonical, count(*) AS mentions FROM runs JOIN aliases USING (alias) GROUP BY ALL),
kept AS (SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY id ORDER BY mentions DESC, canonical) <= 5),
found AS (SELECT id, canonical AS entity, mentions / sum(mentions) OVER (PARTITION BY id) AS weight FROM kept)""",
    ]


_NAMED = f"SELECT doc_id, {B.pick(D.NAMES, 'doc_id')} || ' and ' || {B.pick(D.NAMES, 'doc_id * 3 + 1')} || ' met Open AI. ' || text AS t FROM documents"


@query(
    "f19_entity_mentions",
    B.with_(f"named AS ({_NAMED})", *sql_mentions("named", "doc_id", "t"))
    + "SELECT id AS doc_id, entity, round(weight, 6) AS weight FROM found",
)
def f19(spark, sf):
    named = F.concat(
        D.pick(D.NAMES, c("doc_id")), F.lit(" and "), D.pick(D.NAMES, c("doc_id") * 3 + 1), F.lit(" met Open AI. "), c("text")
    )
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", named.alias("t"))
    return FT.entity_mentions(docs, "doc_id", "t", F.broadcast(FT.static_aliases(spark))).select(
        "doc_id", "entity", F.round("weight", 6).alias("weight")
    )


# The whole feature row: event type, strongest topic, entities with the publisher's own, amount.
_F18_ENT = f"""own AS (SELECT article_id, {_SQL_OWNER.replace('label', "coalesce(source_name, '')")} AS e FROM articles),
ent0 AS (SELECT id AS article_id, entity, weight FROM found),
flagged AS (SELECT o.article_id, o.e, r.is_release, EXISTS (SELECT 1 FROM ent0 x WHERE x.article_id = o.article_id) AS any_ent,
  EXISTS (SELECT 1 FROM ent0 x WHERE x.article_id = o.article_id AND x.entity = o.e) AS present FROM own o JOIN rel r USING (article_id)),
step1 AS (SELECT x.article_id, x.entity, x.weight AS w FROM ent0 x UNION ALL SELECT article_id, e, CASE WHEN any_ent THEN 0.55 ELSE 1.0 END FROM flagged WHERE e IS NOT NULL AND NOT present),
norm1 AS (SELECT article_id, entity, w / sum(w) OVER (PARTITION BY article_id) AS w FROM step1),
step2 AS (SELECT n.article_id, n.entity, CASE WHEN f.is_release AND n.entity = f.e THEN greatest(w, 0.85) ELSE w END AS w FROM norm1 n JOIN flagged f USING (article_id)),
norm2 AS (SELECT article_id, entity, w / sum(w) OVER (PARTITION BY article_id) AS w FROM step2),
ents AS (SELECT article_id, string_agg(entity || '=' || printf('%.4f', w), '|' ORDER BY entity) AS entities FROM norm2 GROUP BY 1)"""
_REL = _F12[len(A):].lstrip().lstrip(",").split("SELECT article_id, official AND artifact")[0]


@query(
    "f18_feature_row",
    B.with_(
        B.ARTICLES, f"tt AS ({_TOPIC_TEXT})", *sql_anchor_sims("tt", "article_id", "t"), _SOFTMAX, _REL.rstrip().rstrip(","),
        "rel AS (SELECT article_id, official AND artifact IS NOT NULL AND (s > 0 OR (r >= 1 AND m >= 2) OR (r >= 2 AND m >= 1)) AS is_release FROM scored)",
        "ft AS (SELECT article_id, title || chr(10) || substr(text, 1, 2000) AS t FROM articles)", *sql_mentions("ft", "article_id", "t"), _F18_ENT,
    )
    + f"""SELECT a.article_id, CASE WHEN is_release THEN 'MODEL_RELEASE' ELSE {_SQL_EVENT} END AS event_type, {sql_amount("title || chr(10) || substr(text, 1, 2000)")} AS amount, coalesce(entities, '') AS entities,
 round(CASE WHEN is_release THEN greatest(p.prob, 0.72) / (greatest(p.prob, 0.72) + 0.28) ELSE p.prob END, 4) AS llms FROM articles a JOIN rel USING (article_id) LEFT JOIN ents USING (article_id)
 JOIN dist p ON p.article_id = a.article_id AND p.topic = 'llms'""",
)
def f18(spark, sf):
    rows = FT.build_features(D.articles(spark, sf), F.broadcast(FT.static_aliases(spark)))
    pairs = F.array_sort(F.map_entries("entities"))
    shown = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"]))), "|")
    return rows.select(
        "article_id", "event_type", c("funding_usd").alias("amount"), shown.alias("entities"), F.round(maps.weight_of(c("topics"), "llms"), 4).alias("llms")
    )


def sql_entity_key(x: str) -> str:
    return (
        f"regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(trim({x}))), '[^A-Za-z0-9_\\s]', ' ', 'g'), "
        f"{B.q(K.CORPORATE_SUFFIXES)}, ' ', 'gi'), '\\s+', '', 'g')"
    )


@query(
    "f20_entity_key",
    f"SELECT name, {sql_entity_key('name')} AS key FROM (SELECT s_name || ' Inc.' AS name FROM supplier UNION ALL "
    "SELECT 'Société ' || c_name || ' Co., Ltd' FROM customer UNION ALL SELECT p_name FROM part)",
)
def f20(spark, sf):
    names = (
        table(spark, sf, "supplier").select(F.concat("s_name", F.lit(" Inc.")).alias("name"))
        .unionByName(table(spark, sf, "customer").select(F.concat(F.lit("Société "), "c_name", F.lit(" Co., Ltd")).alias("name")))
        .unionByName(table(spark, sf, "part").select(F.col("p_name").alias("name")))
    )
    return names.select("name", FT.entity_key(c("name")).alias("key"))


@query(
    "f21_event_family",
    A + f"SELECT event_type, {B.lookup(K.EVENT_FAMILIES, 'lower(trim(event_type))', 'lower(trim(event_type))')} AS family, count(*) AS n FROM articles GROUP BY ALL",
)
def f21(spark, sf):
    return D.articles(spark, sf, text=False).groupBy("event_type", FT.event_family(c("event_type")).alias("family")).agg(
        F.count("*").alias("n")
    )


def sql_rfind(x: str, p: str) -> str:
    return f"(CASE WHEN instr(reverse({x}), {B.q(p[::-1])}) = 0 THEN -1 ELSE length({x}) - instr(reverse({x}), {B.q(p[::-1])}) - {len(p)} + 1 END)"


def sql_clip(x: str) -> str:
    """Expects a compacted text column."""
    head = f"substr({x}, 1, 240)"
    s = "greatest(" + ", ".join(sql_rfind(head, p) for p in (". ", "! ", "? ", "; ", ": ")) + ")"
    w = sql_rfind(head, " ")
    cut = f"(CASE WHEN {s} >= 120 THEN {s} + 1 WHEN {w} >= 120 THEN {w} ELSE 240 END)"
    return f"(CASE WHEN length({x}) <= 240 THEN {x} ELSE rtrim(substr({head}, 1, {cut}), ' ,;:-') || '...' END)"


def sql_odd(s: str) -> str:
    return f"((length({s}) - length(regexp_replace({s}, '[_|\\\\/<>`{{}}\\[\\]]', '', 'g'))) / greatest(length({s}), 1)::DOUBLE)"


_BLURB = [
    f"""flat AS (SELECT article_id, {sql_ws('title')} AS title, {sql_ws('snippet')} AS snippet, {sql_ws('text')} AS body FROM given),
cut AS (SELECT *, CASE WHEN title <> '' AND body <> '' AND starts_with(lower(body), lower(title))
  AND ltrim(substr(body, length(title) + 1), ' :-|.,') <> '' THEN ltrim(substr(body, length(title) + 1), ' :-|.,') ELSE body END AS rest FROM flat),
smp AS (SELECT *, substr(rest, 1, 240) AS s, substr(snippet, 1, 240) AS sn FROM cut),
blurbs AS (SELECT article_id, CASE WHEN sn <> '' AND {sql_odd('sn')} <= 0.03 THEN {sql_clip('snippet')}
  WHEN length(s) >= 40 AND (length(s) - length(regexp_replace(s, '\\p{{L}}', '', 'g'))) / length(s)::DOUBLE >= 0.55
   AND {sql_odd('s')} <= 0.03 AND length(s) - length(replace(s, ' ', '')) >= 5 THEN {sql_clip('rest')} ELSE {sql_clip('title')} END AS blurb FROM smp)"""
]


@query(
    "f22_blurb",
    B.with_(
        B.ARTICLES,
        "given AS (SELECT article_id, title, text, CASE WHEN article_id % 3 = 0 THEN split_part(text, chr(10), 2) "
        "WHEN article_id % 3 = 1 THEN '<<a|b>>' END AS snippet FROM articles)",
        *_BLURB,
    )
    + "SELECT article_id, blurb FROM blurbs",
)
def f22(spark, sf):
    third = F.pmod(c("article_id"), F.lit(3))
    second_line = F.coalesce(F.try_element_at(F.split("text", "\n"), F.lit(2)), F.lit(""))
    snippet = F.when(third == 0, second_line).when(third == 1, "<<a|b>>")
    rows = D.articles(spark, sf).withColumn("snippet", snippet)
    return rows.select(
        "article_id", T.article_blurb(c("title"), F.lit(None).cast("string"), c("snippet"), c("text")).alias("blurb")
    )


_QUALITY = (
    "round(0.70 * least(length({t}) / 5000.0, 1.0) + 0.30 * (1 - least(len(regexp_extract_all(html, '<a[\\s>]')) / "
    "greatest(len(list_filter(string_split({t}, ' '), lambda w: w <> '')), 1) / 0.20, 1.0)), 6)"
)


@query(
    "f23_extraction_quality",
    f"SELECT page_id, {_QUALITY.format(t='t')} AS quality FROM (SELECT page_id, html, {sql_ws(_PLAIN)} AS t FROM pages)",
)
def f23(spark, sf):
    text = T.collapse_ws(T.strip_html(c("html")))
    return table(spark, sf, "pages").select("page_id", F.round(T.extraction_quality(text, c("html")), 6).alias("quality"))


_PARAGRAPHS = f"""scoped AS (SELECT page_id, html AS page, CASE WHEN b <> '' THEN b ELSE html END AS scope FROM (SELECT *, regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1) AS b FROM pages) t),
cut AS (SELECT page_id, page, array_to_string(list_transform(list_filter(string_split(regexp_replace(scope, '(?i)<(/?)(p|h1|h2|h3|li)\\b[^>]*>', chr(1) || '\\1' || chr(2), 'g'), chr(1))[2:],
  lambda x: starts_with(x, chr(2))), lambda x: substr(x, 2)), chr(10) || '<br>' || chr(10)) AS html FROM scoped),
first AS (SELECT page_id, page, {sql_ws(_PLAIN)} AS joined FROM cut),
whole AS (SELECT page_id, html, {sql_ws(_PLAIN)} AS plain FROM pages),
texts AS (SELECT w.page_id, html, CASE WHEN joined <> '' THEN joined ELSE plain END AS t FROM first f JOIN whole w ON w.page_id = f.page_id)"""


@query("f24_page_text", B.with_(_PARAGRAPHS) + f"SELECT page_id, t AS text, {_QUALITY.format(t='t')} AS quality FROM texts")
def f24(spark, sf):
    text = T.page_text(c("html"))
    return (
        spread(table(spark, sf, "pages"), "page_id")
        .select("page_id", text.alias("text"), "html")
        .select("page_id", "text", F.round(T.extraction_quality(c("text"), c("html")), 6).alias("quality"))
    )


@query(
    "f25_watch_band_text",
    f"SELECT page_id, substr(t, 1, 500) AS text, least(0.29, {_QUALITY.format(t='substr(t, 1, 500)')}) AS quality "
    f"FROM (SELECT page_id, html, {sql_ws(_PLAIN)} AS t FROM pages)",
)
def f25(spark, sf):
    cut = F.substring(T.collapse_ws(T.strip_html(c("html"))), 1, 500)
    return table(spark, sf, "pages").select(
        "page_id", cut.alias("text"), F.least(F.lit(0.29), F.round(T.extraction_quality(cut, c("html")), 6)).alias("quality")
    )


_F26_HTML = (
    "CASE page_id % 3 WHEN 0 THEN '<meta property=\"article:published_time\" content=\"' || strftime(ts - to_days(CAST(page_id % 9 AS INTEGER)), '%Y-%m-%d') "
    "|| 'T08:00:00Z\">' WHEN 1 THEN '<time class=\"d\" datetime=\"' || strftime(ts - to_days(1), '%Y-%m-%d') || '\">x</time>' ELSE '' END || html"
)


@query(
    "f26_publication_date",
    f"""WITH base AS (SELECT page_id, ts, {_F26_HTML} AS html FROM pages JOIN (SELECT event_id // 40 AS page_id, max(ts) AS ts FROM events GROUP BY 1) e USING (page_id)),
found AS (SELECT page_id, ts, try_cast(coalesce(
  nullif(regexp_extract(html, '(?is)<meta[^>]+(?:article:published_time|datePublished|pubdate|date)["''][^>]*content=["'']([0-9-]{{10}})', 1), ''),
  nullif(regexp_extract(html, '(?is)<time[^>]+datetime=["'']([0-9-]{{10}})', 1), '')) AS TIMESTAMP) AS page_time FROM base),
fixed AS (SELECT page_id, page_time, CASE WHEN epoch_us(ts) - epoch_us(page_time) > 86400000000 THEN page_time ELSE ts END AS published,
  epoch_us(ts) - epoch_us(page_time) > 86400000000 AS corrected FROM found)
SELECT page_id, epoch_us(page_time) AS page_us, epoch_us(published) AS published_us FROM fixed
WHERE NOT (coalesce(corrected, false) AND published < (SELECT max(ts) FROM events) - INTERVAL 168 HOUR)""",
)
def f26(spark, sf):
    i = c("page_id")
    day = lambda n: F.date_format(F.date_sub(c("ts"), n), "yyyy-MM-dd")
    lead = (
        F.when(
            F.pmod(i, F.lit(3)) == 0,
            F.concat(
                F.lit('<meta property="article:published_time" content="'),
                day(F.pmod(i, F.lit(9)).cast("int")),
                F.lit('T08:00:00Z">'),
            ),
        )
        .when(F.pmod(i, F.lit(3)) == 1, F.concat(F.lit('<time class="d" datetime="'), day(F.lit(1)), F.lit('">x</time>')))
        .otherwise("")
    )
    rows = (
        table(spark, sf, "pages")
        .join(table(spark, sf, "events").groupBy(F.floor(c("event_id") / 40).cast("long").alias("page_id")).agg(F.max("ts").alias("ts")), "page_id")
        .withColumn("html", F.concat(lead, c("html")))
    )
    from newsgraph.sources.landing import correct_sitemap_dates

    fixed = correct_sitemap_dates(rows, "ts", "html", F.lit(as_of(spark, sf)))
    return fixed.select(
        "page_id", F.unix_micros("page_time").alias("page_us"), F.unix_micros("published_at").alias("published_us")
    )


_CATEGORY = f"""ranked AS (SELECT article_id, topic, weight FROM topic_rows WHERE weight >= 0.35 AND topic IN {B.lst(K.TOPIC_CATEGORY)}
  QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY weight DESC, topic) = 1),
product AS (SELECT DISTINCT article_id FROM topic_rows WHERE weight >= 0.42 AND topic IN {B.lst(K.PRODUCT_TOPICS)}),
categories AS (SELECT a.article_id, coalesce({B.lookup(K.EVENT_CATEGORY, 'a.event_type')}, {B.lookup(K.TOPIC_CATEGORY, 'r.topic')},
  CASE WHEN p.article_id IS NOT NULL THEN 'Product' ELSE 'General' END) AS category
  FROM articles a LEFT JOIN ranked r USING (article_id) LEFT JOIN product p USING (article_id))"""


@query("f27_category", B.with_(B.ARTICLES, B.TOPIC_ROWS, _CATEGORY) + "SELECT article_id, category FROM categories")
def f27(spark, sf):
    return D.articles(spark, sf, text=False).select("article_id", CD.category(c("event_type"), c("topics")).alias("category"))


def _sql_chips() -> str:
    rows = []
    for event, chips in K.EVENT_SEED_CHIPS.items():
        for chip in chips:
            bucket = 0 if chip in K.CORE_SEED_CHIPS else 1
            rows.append(f"SELECT article_id, {B.q(chip)} AS chip, {bucket} AS bucket FROM articles WHERE event_type = {B.q(event)}")
    for chip, bucket, pattern in K.CHIP_KEYWORDS:
        rows.append(
            f"SELECT article_id, {B.q(chip)}, {0 if bucket == 'core' else 1} FROM articles WHERE "
            + B.has("title || ' ' || source_name", pattern)
        )
    for topic, chips in K.TOPIC_CHIPS.items():
        for chip in chips:
            rows.append(
                f"SELECT article_id, {B.q(chip)}, {1 if chip in K.CONTEXT_CHIPS else 0} FROM topic_rows "
                f"WHERE topic = {B.q(topic)} AND weight >= 0.25"
            )
    return "chip_hits AS (" + " UNION ALL ".join(rows) + ")"


_CHIPS = f"""chip_best AS (SELECT h.article_id, chip, min(bucket) AS bucket FROM chip_hits h JOIN categories k USING (article_id)
  WHERE NOT (chip = category AND category IN {B.lst(K.SUPPRESSED_CHIP)}) GROUP BY ALL),
chip_kept AS (SELECT article_id, chip, row_number() OVER (PARTITION BY article_id ORDER BY bucket, list_position({B.arr(K.CHIP_ORDER)}, chip)) AS rn FROM chip_best)"""


@query(
    "f28_topic_chips",
    B.with_(B.ARTICLES, B.TOPIC_ROWS, _CATEGORY, _sql_chips(), _CHIPS)
    + "SELECT a.article_id, coalesce(string_agg(chip, '|' ORDER BY rn) FILTER (rn <= 4), '') AS chips FROM articles a "
    "LEFT JOIN chip_kept k USING (article_id) GROUP BY a.article_id",
)
def f28(spark, sf):
    rows = D.articles(spark, sf).withColumn("category", CD.category(c("event_type"), c("topics")))
    chips = CD.topic_chips(
        c("category"), c("event_type"), c("topics"), c("title"), F.lit(None).cast("string"), c("source_name")
    )
    return rows.select("article_id", F.array_join(chips, "|").alias("chips"))


_SITE = f"regexp_replace({B.host('final_url')}, '^www\\.', '')"
_LABEL = f"replace(regexp_extract({_SITE}, '([^.]+)(?:\\.[^.]+)?$', 1), '-', ' ')"
_TITLED = f"array_to_string(list_transform(string_split({_LABEL}, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
_LINKED = f"({_SITE} <> '' AND (" + " OR ".join(
    f"(source_kind = {B.q(k)} AND {_SITE} NOT IN {B.lst(v)})" for k, v in K.PLATFORM_HOSTS.items()
) + "))"


SQL_SHOWN_SOURCE = f"(CASE WHEN {_LINKED} THEN {B.lookup(K.HOST_BRANDS, _SITE, _TITLED)} ELSE source_name END)"


@query(
    "f29_source_attribution",
    A + f"SELECT article_id, {SQL_SHOWN_SOURCE} AS source, "
    f"CASE WHEN {_LINKED} THEN source_name END AS via FROM articles",
)
def f29(spark, sf):
    return (
        D.articles(spark, sf, text=False)
        .select("article_id", CD.attribution(c("source_kind"), c("source_name"), c("final_url")).alias("a"))
        .select("article_id", "a.source", "a.via")
    )


SQL_EVENT_TIME = (
    f"CASE WHEN source_kind IN {B.lst(K.FETCHED_ALWAYS_KINDS)} THEN fetched_at WHEN published_at IS NOT NULL THEN published_at "
    f"WHEN source_kind IN {B.lst(K.FETCHED_FALLBACK_KINDS)} THEN fetched_at END"
)


@query("f30_event_time", A + f"SELECT article_id, epoch_us({SQL_EVENT_TIME}) AS event_us FROM articles")
def f30(spark, sf):
    when = S.event_time(c("source_kind"), c("published_at"), c("fetched_at"))
    return D.articles(spark, sf, text=False).select("article_id", F.unix_micros(when).alias("event_us"))


def sql_fresh(cutoff: str) -> str:
    return (
        f"(published_at >= {cutoff} OR (published_at IS NULL AND source_kind IN {B.lst(K.FETCHED_FALLBACK_KINDS)} AND fetched_at >= {cutoff}) "
        f"OR (source_kind IN {B.lst(K.FETCHED_ALWAYS_KINDS)} AND fetched_at >= {cutoff}))"
    )


@query(
    "f31_freshness",
    A + f"SELECT article_id FROM articles WHERE {sql_fresh('(SELECT max(ts) FROM events) - INTERVAL 72 HOUR')}",
)
def f31(spark, sf):
    cutoff = F.lit(as_of(spark, sf)) - F.expr("INTERVAL 72 HOURS")
    rows = D.articles(spark, sf, text=False)
    return rows.filter(S.is_fresh(c("source_kind"), c("published_at"), c("fetched_at"), cutoff)).select("article_id")


@query("f32_log_norm", f"SELECT event_id, round({B.log_share('value', 500)}, 6) AS share FROM events")
def f32(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(S.log_share(c("value"), 500), 6).alias("share"))


_STATEMENT = (
    "'SELECT  *' || chr(10) || 'FROM t' || (event_id % 3) || ' WHERE kind = ''' || event_type || ''' AND id IN (' || event_id || ', ' "
    "|| user_id || ', 7)  LIMIT ' || (event_id % 50)"
)
_SHAPE = (
    "substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace({s}, '\\s+', ' ', 'g'), '''[^'']*''', '''?''', 'g'), "
    "'\\b\\d+\\b', '?', 'g'), '\\(\\?\\s*(?:,\\s*\\?)*\\)', '(?...)', 'g'), 1, 500)"
)


def statements(spark, sf):
    text = F.concat(
        F.lit("SELECT  *\nFROM t"), F.pmod("event_id", F.lit(3)).cast("string"), F.lit(" WHERE kind = '"), c("event_type"),
        F.lit("' AND id IN ("), c("event_id").cast("string"), F.lit(", "), c("user_id").cast("string"), F.lit(", 7)  LIMIT "),
        F.pmod("event_id", F.lit(50)).cast("string"),
    )
    return table(spark, sf, "events").withColumn("sql_text", text)


@query(
    "f33_sql_fingerprint",
    f"SELECT event_id, {_SHAPE.format(s=_STATEMENT)} AS fingerprint, substr(md5({_SHAPE.format(s=_STATEMENT)}), 1, 12) AS hash FROM events",
)
def f33(spark, sf):
    shape = CD.sql_fingerprint(c("sql_text"))
    return statements(spark, sf).select("event_id", shape.alias("fingerprint"), F.substring(F.md5(shape), 1, 12).alias("hash"))


_BODY = "CASE page_id % 4 WHEN 0 THEN '<?xml version=\"1.0\"?><rss>' || url || '</rss>' WHEN 1 THEN html ELSE '<div>challenge-platform</div>' END"


@query(
    "f34_payload_health",
    f"""WITH landed AS (SELECT page_id, {B.pick([200, 200, 200, 200, 200, 403, 404, 410, 429, 503, 302], 'page_id')} AS status, {_BODY} AS body FROM pages),
judged AS (SELECT CASE WHEN status IN (403, 429) THEN 'blocked' WHEN status = 404 THEN 'not_found' WHEN status = 410 THEN 'gone'
  WHEN status >= 500 THEN 'server_error' WHEN status <> 200 THEN 'unexpected_status'
  WHEN contains(body, 'challenge-platform') THEN 'challenge_page' WHEN contains(body, '<rss') THEN 'feed'
  WHEN contains(lower(body), '<html') THEN 'html_not_feed' ELSE 'unrecognised' END AS outcome FROM landed)
SELECT outcome, count(*) AS n FROM judged GROUP BY 1""",
)
def f34(spark, sf):
    i = c("page_id")
    body = (
        F.when(F.pmod(i, F.lit(4)) == 0, F.concat(F.lit('<?xml version="1.0"?><rss>'), c("url"), F.lit("</rss>")))
        .when(F.pmod(i, F.lit(4)) == 1, c("html"))
        .otherwise("<div>challenge-platform</div>")
    )
    status = D.pick([200, 200, 200, 200, 200, 403, 404, 410, 429, 503, 302], i)
    return (
        table(spark, sf, "pages")
        .select(CD.payload_health(status, body, F.lit("rss")).alias("outcome"))
        .groupBy("outcome")
        .agg(F.count("*").alias("n"))
    )


@query(
    "f35_compact_payload",
    A + "SELECT article_id, '{\"type\":\"urgent_update\",\"id\":' || article_id || CASE WHEN hn_points IS NOT NULL THEN ',\"points\":' || hn_points ELSE '' END "
    "|| CASE WHEN cluster_id IS NOT NULL THEN ',\"cluster\":' || cluster_id ELSE '' END || '}' AS payload FROM articles",
)
def f35(spark, sf):
    payload = CD.compact_json(type=F.lit("urgent_update"), id=c("article_id"), points=c("hn_points"), cluster=c("cluster_id"))
    return D.articles(spark, sf, text=False).select("article_id", payload.alias("payload"))


@query(
    "f36_topic_labels",
    B.with_(B.TOPIC_ROWS) + f"SELECT {B.lookup(K.TOPIC_LABELS, 'topic')} AS label, count(*) AS n, round(sum(weight), 4) AS total FROM topic_rows GROUP BY 1",
)
def f36(spark, sf):
    rows = D.article_tags(spark, sf).select(F.explode("topics").alias("topic", "w"))
    return rows.groupBy(maps.lookup(K.TOPIC_LABELS, c("topic")).alias("label")).agg(
        F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("total")
    )


@query(
    "f37_vector_validity",
    "SELECT count(*) AS n, count(*) FILTER (len(embedding) = 64) AS valid, count(*) FILTER (len(embedding) = 384) AS valid_384 FROM embeddings",
)
def f37(spark, sf):
    ok = lambda dim: F.count_if(F.coalesce(F.size("embedding") == dim, F.lit(False)))
    return table(spark, sf, "embeddings").agg(F.count("*").alias("n"), ok(64).alias("valid"), ok(384).alias("valid_384"))
