"""K rows and the joins they rest on: vectors, clustering, names and relationship graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsgraph import constants as K
from newsgraph.catalog import sqlbase as B
from newsgraph.catalog.scalars import sql_entity_key
from newsgraph.catalog.scores import CLUSTER
from newsgraph.catalog.sets import DOM_ENTS, DOM_EVENT, DOM_TOPIC
from newsgraph.operators import cluster_state as CS, clustering as CL, copies, graph as G, vectors as V
from newsgraph.session import cut_lineage, shared_folder
from newsgraph.sources import standin as D
from newsgraph.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}
c = F.col
DIM = 64


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def sql_dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def labelled_vectors(spark, sf):
    """Vectors pulled towards the first vector of their label, so that stories have copies and near copies."""
    rows = D.vectors(spark, sf)
    base = rows.groupBy("label").agg(F.min_by("embedding", "article_id").alias("base"))
    pulled = F.zip_with("embedding", "base", lambda e, b: e * F.lit(0.45) + b)
    times = table(spark, sf, "events").select((c("event_id")).alias("article_id"), F.unix_micros("ts").alias("time_us"))
    return rows.join(base, "label").join(times, "article_id").select(
        "article_id", "label", "time_us", pulled.cast("array<double>").alias("vec")
    )


_LABELLED = f"""base AS (SELECT label, arg_min(embedding, vec_id) AS b FROM embeddings GROUP BY 1),
pulled AS (SELECT vec_id AS id, epoch_us(ts) AS t, list_transform(list_zip(embedding, b), lambda z: z[1]::DOUBLE * 0.45 + z[2]::DOUBLE) AS p
  FROM embeddings JOIN base USING (label) JOIN events ON event_id = vec_id),
queue AS MATERIALIZED (SELECT row_number() OVER (ORDER BY t, id) AS i, id, t, list_transform(p, lambda c: c / sqrt({sql_dot('p', 'p')})) AS x FROM pulled)"""


def sql_leaders(threshold: float, unit_centroid: bool, lookback_us: int | None, name: str) -> str:
    """Items one by one against the clusters so far, kept as lists: ``{name}(i, id, cluster, similarity)``."""
    dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
    sim = dot("k.v", "x") if unit_centroid else f"(CASE WHEN {dot('k.v', 'k.v')} > 0 THEN {dot('k.v', 'x')} / sqrt({dot('k.v', 'k.v')}) ELSE 0 END)"
    sim = f"round({sim}, 9)"
    if lookback_us is not None:
        sim = f"CASE WHEN k.seen >= t - {lookback_us} THEN {sim} ELSE -2.0 END"
    moved = "list_transform(list_zip(held[best].v, x), lambda z: (z[1] * held[best].n + z[2]) / (held[best].n + 1))"
    place = f"list_transform(moved, lambda c: c / sqrt({dot('moved', 'moved')}))" if unit_centroid else "moved"
    return f"""{name}_run(i, id, cluster, similarity, held) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, CAST([] AS STRUCT(name BIGINT, v DOUBLE[], n BIGINT, seen BIGINT)[])
  UNION ALL
  SELECT i, id, CASE WHEN hit THEN held[best].name ELSE id END, CASE WHEN hit THEN top ELSE 1.0 END,
    CASE WHEN hit THEN list_transform(held, lambda k, j: CASE WHEN j = best THEN struct_pack(name := k.name, v := {place}, n := k.n + 1, seen := greatest(k.seen, t)) ELSE k END)
         ELSE list_append(held, struct_pack(name := id, v := x, n := 1::BIGINT, seen := t)) END
  FROM (SELECT *, CASE WHEN hit THEN {moved} END AS moved FROM (SELECT *, coalesce(top >= {threshold}, false) AS hit, list_position(sims, top) AS best FROM (SELECT *, list_max(sims) AS top
    FROM (SELECT q.i, q.id, q.t, q.x, r.held, list_transform(r.held, lambda k: {sim}) AS sims FROM {name}_run r JOIN queue q ON q.i = r.i + 1) a) b) c) d),
{name} AS (SELECT i, id, cluster, similarity FROM {name}_run WHERE i > 0)"""


def recursive(*parts: str) -> str:
    return B.with_(*parts).replace("WITH", "WITH RECURSIVE", 1)


@query(
    "k01_ordered_clusters",
    recursive(_LABELLED, sql_leaders(0.86, True, CL.WEEK_US, "lead")) + "SELECT id AS article_id, cluster, round(similarity, 6) AS similarity FROM lead",
)
def k01(spark, sf):
    found = CL.ordered_clusters(labelled_vectors(spark, sf), "article_id", "vec", "time_us", 0.86)
    return found.select("article_id", "cluster", F.round("similarity", 6).alias("similarity"))


def _in_batches(spark, sf, batches: int = 4):
    """The labelled vectors taken in spans of time through a stored state, the last span twice."""
    rows = cut_lineage(labelled_vectors(spark, sf))
    low, high = rows.agg(F.min("time_us"), F.max("time_us")).first()
    store = CS.ClusterStore(spark, f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}", CS.Rule(0.86))
    span = F.least(F.floor((c("time_us") - low) * batches / max(1, high - low)), F.lit(batches - 1))
    for batch in [*range(batches), batches - 1]:
        store.advance(rows.filter(span == batch), "article_id", "vec", "time_us")
    return store


@query(
    "k01_batched_clusters",
    recursive(_LABELLED, sql_leaders(0.86, True, CS.WEEK_US, "lead")) + "SELECT id AS article_id, cluster, round(similarity, 6) AS similarity FROM lead",
)
def k01_batched(spark, sf):
    found = _in_batches(spark, sf).read_members()
    return found.select("article_id", "cluster", F.round("similarity", 6).alias("similarity"))


@query(
    "k03_running_centroids",
    recursive(_LABELLED, sql_leaders(0.86, True, CS.WEEK_US, "lead"))
    + f"""SELECT k.name AS cluster, k.n AS n, unnest(range({DIM})) AS dim, round(unnest(k.v), 6) AS value
FROM (SELECT unnest(held) AS k FROM lead_run WHERE i = (SELECT max(i) FROM queue)) x""",
)
def k03_running(spark, sf):
    found = _in_batches(spark, sf).read_clusters()
    return found.select("cluster", "n", F.posexplode("v").alias("dim", "x")).select("cluster", "n", "dim", F.round("x", 6).alias("value"))


def _sweep(threshold: float) -> str:
    name = f"s{round(threshold * 100)}"
    return f"""SELECT {threshold} AS threshold, count(*) AS clusters, round(avg(n), 6) AS mean_size, count(*) FILTER (n = 1) AS singletons,
 round(count(*) FILTER (n = 1) / greatest(count(*), 1), 6) AS fragmentation FROM (SELECT cluster, count(*) AS n FROM {name} GROUP BY 1)"""


@query(
    "k02_threshold_sweep",
    recursive(_LABELLED, *(sql_leaders(t, False, None, f"s{round(t * 100)}") for t in (0.78, 0.82, 0.86))) + " UNION ALL ".join(map(_sweep, (0.78, 0.82, 0.86))),
)
def k02(spark, sf):
    report = CL.threshold_sweep(labelled_vectors(spark, sf), "article_id", "vec", "time_us", [0.78, 0.82, 0.86])
    return report.select("threshold", "clusters", F.round("mean_size", 6).alias("mean_size"), "singletons", F.round("fragmentation", 6).alias("fragmentation"))


_MEANS = ", ".join(f"avg(embedding[{i}]::DOUBLE)" for i in range(1, DIM + 1))


@query(
    "k03_centroids",
    f"""WITH m AS (SELECT label, count(*) AS n, [{_MEANS}] AS v FROM embeddings GROUP BY 1), u AS (SELECT label, n, v, sqrt({sql_dot('v', 'v')}) AS s FROM m),
d AS (SELECT label, n, s, unnest(v) AS x, unnest(range({DIM})) AS dim FROM u) SELECT label, n, dim, round(x / s, 6) AS value FROM d""",
)
def k03(spark, sf):
    means = V.mean_vectors(D.vectors(spark, sf), "label", "embedding")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return means.withColumn("s", length).select("label", "n", "s", F.posexplode("embedding").alias("dim", "x")).select(
        "label", "n", "dim", F.round(c("x") / c("s"), 6).alias("value")
    )


@query(
    "k04_nearest_neighbours",
    f"""WITH p AS (SELECT a.vec_id, b.vec_id AS neighbour, round({sql_dot('a.embedding', 'b.embedding')} / sqrt({sql_dot('a.embedding', 'a.embedding')} * {sql_dot('b.embedding', 'b.embedding')}), 9) AS s
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT vec_id, neighbour, round(s, 6) AS similarity, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour) AS rank FROM p QUALIFY rank <= 5""",
)
def k04(spark, sf):
    rows = D.vectors(spark, sf).select(c("article_id").alias("vec_id"), "embedding")
    near = V.neighbours(rows, "vec_id", "embedding", 5)
    return near.select("vec_id", "neighbour", F.round("similarity", 6).alias("similarity"), "rank")


_CENT = f"""cent AS (SELECT label, [{_MEANS}] AS v FROM embeddings GROUP BY 1),
sims AS (SELECT e.vec_id, x.label, {sql_dot('e.embedding', 'x.v')} / sqrt({sql_dot('e.embedding', 'e.embedding')} * {sql_dot('x.v', 'x.v')}) AS s, e.label AS own FROM embeddings e CROSS JOIN cent x)"""


@query(
    "k05_novelty_similarity",
    B.with_(_CENT, "seen AS (SELECT label, max(ts) AS last_seen FROM embeddings JOIN events ON event_id = vec_id GROUP BY 1), recent AS (SELECT label FROM seen WHERE last_seen >= (SELECT max(last_seen) FROM seen) - INTERVAL 6 HOUR)")
    + "SELECT vec_id, round(greatest(0.0, coalesce(max(s) FILTER (label <> own AND label IN (SELECT label FROM recent)), 0.0)), 6) AS novelty_similarity FROM sims GROUP BY 1",
)
def k05(spark, sf):
    from newsgraph.operators.clustering import novelty_similarity

    rows = D.vectors(spark, sf).select(c("article_id").alias("vec_id"), "embedding", c("label").alias("own"))
    # The given vectors lie close in time: six hours of look-back leave some of their labels out.
    times = table(spark, sf, "events").select(c("event_id").alias("vec_id"), "ts")
    seen = rows.join(times, "vec_id").groupBy(c("own").alias("cluster")).agg(F.max("ts").alias("last_seen"))
    centroids = V.mean_vectors(rows, "own", "embedding").select(c("own").alias("cluster"), "embedding").join(seen, "cluster")
    latest = F.lit(seen.agg(F.max("last_seen")).first()[0])
    found = novelty_similarity(rows, "vec_id", "own", centroids, "cluster", "embedding", latest - F.expr("interval 6 hours"))
    return found.select("vec_id", F.round("similarity", 6).alias("novelty_similarity"))


def _sql_axis(name: str, matrix: str, squarings: int = 18) -> str:
    """First principal axis of a symmetric matrix, a list of rows one after another, by repeated squaring: ``{name}(v, strength)``."""
    row = lambda m, i: f"{m}[{i} * {DIM} + 1 : {i} * {DIM} + {DIM}]"
    return f"""{name}_run(k, m) AS (
  SELECT 0, m FROM {matrix}
  UNION ALL
  SELECT k + 1, list_transform(p, lambda z: z / list_max(p)) FROM (
    SELECT k, list_transform(range({DIM * DIM}), lambda i: list_inner_product({row('m', '(i // ' + str(DIM) + ')')}, {row('m', '(i % ' + str(DIM) + ')')})) AS p FROM {name}_run WHERE k < {squarings}) t),
{name}_row AS (SELECT list_transform(range({DIM}), lambda i: m[i * {DIM} + i + 1]) AS diagonal, m FROM {name}_run WHERE k = {squarings}),
{name}_at AS (SELECT list_position(diagonal, list_max(diagonal)) - 1 AS i, m FROM {name}_row),
{name}_raw AS (SELECT {row('m', 'i')} AS w FROM {name}_at),
{name}_unit AS (SELECT list_transform(w, lambda z: z / sqrt(list_inner_product(w, w))) AS u FROM {name}_raw),
{name}_signed AS (SELECT u, list_transform(u, lambda z: abs(z)) AS a FROM {name}_unit),
{name} AS (SELECT list_transform(u, lambda z: z * sign(u[list_position(a, list_max(a))])) AS v FROM {name}_signed)"""


_PLANE = recursive(
    f"""xs AS (SELECT vec_id AS article_id, list_transform(embedding, lambda z: z::DOUBLE) AS x FROM embeddings),
long AS (SELECT article_id, unnest(x) AS z, unnest(range({DIM})) AS d FROM xs),
means AS (SELECT d, avg(z) AS mean FROM long GROUP BY d),
centred AS (SELECT article_id, list(z - mean ORDER BY d) AS x FROM long JOIN means USING (d) GROUP BY article_id),
cells AS (SELECT p, sum(x[p // {DIM} + 1] * x[p % {DIM} + 1]) AS z FROM centred, range({DIM * DIM}) r(p) GROUP BY p),
cov AS (SELECT list(z ORDER BY p) AS m FROM cells)""",
    _sql_axis("one", "cov"),
    f"""power AS (SELECT v, list_inner_product(v, list_transform(range({DIM}), lambda i: list_inner_product(m[i * {DIM} + 1 : i * {DIM} + {DIM}], v))) AS strength, m FROM one, cov),
rest AS (SELECT list_transform(range({DIM * DIM}), lambda p: m[p + 1] - strength * v[p // {DIM} + 1] * v[p % {DIM} + 1]) AS m FROM power)""",
    _sql_axis("two", "rest"),
    "placed AS (SELECT article_id, list_inner_product(x, one.v) AS a, list_inner_product(x, two.v) AS b FROM centred, one, two)",
) + """SELECT article_id, round((a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()), 4) AS x,
 round((b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()), 4) AS y FROM placed"""


@query("k07_plane", _PLANE)
def k07(spark, sf):
    points = V.plane(D.vectors(spark, sf), "article_id", "embedding")
    return points.select("article_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(
    "j09_similarity_join",
    B.with_(_CENT) + "SELECT vec_id, label AS cluster, round(s, 6) AS similarity FROM sims WHERE s >= 0.25 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, label) = 1",
)
def j09(spark, sf):
    rows = D.vectors(spark, sf).select(c("article_id").alias("vec_id"), "embedding", "label")
    centroids = V.mean_vectors(rows, "label", "embedding").select(c("label").alias("cluster"), "embedding")
    near = V.nearest(rows, centroids, "vec_id", "cluster", "embedding", 1, at_least=0.25)
    return near.select("vec_id", "cluster", F.round("similarity", 6).alias("similarity"))


def name_rows(spark, sf):
    """Names with variants: word order, case and a suffix."""
    s = table(spark, sf, "supplier").select(F.explode(F.array(
        c("s_name"), F.lower("s_name"), F.concat(c("s_name"), F.lit(" Inc")), F.concat(F.lit("Inc "), c("s_name"))
    )).alias("name"))
    p = table(spark, sf, "part").select(F.explode(F.array(c("p_name"), F.concat_ws(" ", F.reverse(F.split("p_name", " "))))).alias("name"))
    a = D.articles(spark, sf, text=False).select(F.explode(F.map_keys("entities")).alias("name"))
    return s.unionByName(p).unionByName(a)


@query("k09_entity_resolution")
def k09(spark, sf):
    return CL.resolve_entities(name_rows(spark, sf), "name").select("k", "canonical")


@query("k09_canonical_map")
def k09_map(spark, sf):
    return CL.canonical_map(CL.resolve_entities(name_rows(spark, sf), "name"))


@query(
    "k12_near_copies",
    """WITH rows AS (SELECT md5(lower(substr(text, 1, 6))) AS cluster_id, doc_id AS article_id, substr(text, 1, 500) AS t FROM documents WHERE text <> ''),
sh AS (SELECT cluster_id, article_id, list_distinct(list_transform(range(1, greatest(length(t) - 3, 1) + 1), lambda i: substr(t, i, 4))) AS s FROM rows),
f AS (SELECT cluster_id, min(article_id) AS first_id FROM rows GROUP BY 1),
p AS (SELECT b.cluster_id, b.article_id, first_id, 2.0 * len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s)) AS ratio
  FROM f JOIN sh a ON a.article_id = first_id JOIN sh b ON b.cluster_id = f.cluster_id WHERE b.article_id <> first_id)
SELECT cluster_id, article_id, first_id, round(ratio, 6) AS ratio FROM p WHERE ratio > 0.6""",
)
def k12(spark, sf):
    return copies.echo_pairs(_opening_alike(spark, sf), blocks=False).select("cluster_id", "article_id", "first_id", F.round("ratio", 6).alias("ratio"))


@query("k12_block_copies")
def k12_blocks(spark, sf):
    return copies.echo_pairs(_opening_alike(spark, sf)).select("cluster_id", "article_id", "first_id", F.round("ratio", 6).alias("ratio"))


def _opening_alike(spark, sf):
    """Texts that open alike form a cluster; most of them are not copies."""
    docs = table(spark, sf, "documents").select(c("doc_id").alias("article_id"), "text")
    return docs.withColumn("cluster_id", F.md5(F.lower(F.substring("text", 1, 6))))


# --- graph nodes ------------------------------------------------------------------------------
# One graph per week; clusters are (week, reader group) so that several graphs exist side by side.

_WEEK_START = 1704067200


def graph_articles(spark, sf, text=False):
    week = F.floor((F.unix_seconds("created_at") - _WEEK_START) / 604800)
    rows = D.articles(spark, sf, text=text)
    return rows.withColumn(
        "cluster_id",
        F.when(c("cluster_id").isNotNull(), F.concat(week.cast("string"), F.lit("-"), F.pmod("cluster_id", F.lit(60)).cast("string"))),
    )


def graph_nodes(spark, sf):
    nodes = G.cluster_nodes(graph_articles(spark, sf), D.article_vectors(spark, sf), F.substring_index(c("cluster_id"), "-", 1))
    nodes = cut_lineage(nodes)
    # only the documents of the nodes: at most MAX_NODES a graph, and no whole text leaves the scan
    docs = table(spark, sf, "documents").join(nodes.select(c("top_article_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    title, body = D.title_text(c("doc_id"), c("text"))
    titles = docs.select(c("doc_id").alias("top_article_id"), title.alias("headline"), F.substring(body, 1, 300).alias("top_summary"))
    # At most MAX_NODES rows per graph; edges, views and prompts all start from them.
    return cut_lineage(nodes.join(titles, "top_article_id", "left"))


_GA = f"""garticles AS (SELECT * REPLACE (CASE WHEN cluster_id IS NOT NULL THEN CAST(CAST(floor((epoch_us(created_at) / 1e6 - {_WEEK_START}) / 604800) AS BIGINT) AS VARCHAR) || '-' || (cluster_id % 60) END AS cluster_id) FROM articles)"""
_GC = CLUSTER.replace("FROM articles", "FROM garticles")
_NODE_CENT = f"""ncent AS (SELECT cluster_id, [{_MEANS}] AS v FROM members m JOIN embeddings e ON e.vec_id = m.article_id % (SELECT count(*) FROM embeddings) GROUP BY 1),
nunit AS (SELECT cluster_id, v, sqrt({sql_dot('v', 'v')}) AS len FROM ncent)"""
_NODES = f"""lead AS (SELECT *, split_part(cluster_id, '-', 1) AS graph_id, coalesce({B.hours('first_seen', 'last_seen')}, 0.0) AS age_hours,
  coverage / greatest(coalesce({B.hours('first_seen', 'last_seen')}, 0.0), 0.1) AS velocity FROM cstats
  QUALIFY row_number() OVER (PARTITION BY split_part(cluster_id, '-', 1) ORDER BY top_score DESC, cluster_id) <= 80),
nodes AS (SELECT l.*, velocity >= 1.0 AND row_number() OVER (PARTITION BY graph_id ORDER BY velocity DESC, cluster_id) <= 5 AS pulsing,
  coalesce(t.dominant_topic, 'mixed') AS dominant_topic, coalesce(e.dominant_event_type, 'MIXED') AS dominant_event_type, u.v, u.len,
  {B.lookup(K.EVENT_FAMILIES, "lower(coalesce(e.dominant_event_type, 'MIXED'))", "lower(coalesce(e.dominant_event_type, 'MIXED'))")} AS family
  FROM lead l LEFT JOIN dom_topic t USING (cluster_id) LEFT JOIN dom_event e USING (cluster_id) LEFT JOIN nunit u USING (cluster_id))"""
NODES = [B.ARTICLES, B.TOPIC_ROWS, B.ENTITY_ROWS, _GA, _GC, DOM_TOPIC, DOM_EVENT, DOM_ENTS, _NODE_CENT, _NODES]
_PAIR_SQL = f"""nent AS (SELECT cluster_id, {sql_entity_key('entity')} AS k, arg_max(entity, pos) AS name FROM cents GROUP BY ALL),
shared AS (SELECT a.cluster_id AS source, b.cluster_id AS target, count(*) AS n_shared, string_agg(a.name, ', ' ORDER BY a.name) AS names
  FROM nent a JOIN nent b ON a.k = b.k AND a.cluster_id < b.cluster_id GROUP BY ALL),
tdot AS (SELECT a.cluster_id AS source, b.cluster_id AS target, sum(a.mean * b.mean) AS dot FROM tmean a JOIN tmean b ON a.topic = b.topic AND a.cluster_id < b.cluster_id GROUP BY ALL),
tlen AS (SELECT cluster_id, sum(mean * mean) AS s FROM tmean GROUP BY 1),
raw_pairs AS (SELECT l.graph_id, l.cluster_id AS source, r.cluster_id AS target, coalesce(n_shared, 0) AS n_shared, names,
  CASE WHEN l.len > 0 AND r.len > 0 THEN {sql_dot('l.v', 'r.v')} / (l.len * r.len) ELSE 0.0 END AS emb_sim,
  (l.family || ':' || r.family IN {B.lst(K.CHAINED_FAMILIES)} OR r.family || ':' || l.family IN {B.lst(K.CHAINED_FAMILIES)}) AS compatible,
  l.age_hours AS l_age, r.age_hours AS r_age, l.coverage AS l_cov, r.coverage AS r_cov, l.dominant_topic AS lt, r.dominant_topic AS rt,
  {B.clamp("coalesce(dot / sqrt(ls.s * rs.s), 0.0) + CASE WHEN l.dominant_topic = r.dominant_topic THEN 0.12 ELSE 0 END")} AS topic_sim
  FROM nodes l JOIN nodes r ON l.graph_id = r.graph_id AND l.cluster_id < r.cluster_id
  LEFT JOIN shared ON shared.source = l.cluster_id AND shared.target = r.cluster_id LEFT JOIN tdot ON tdot.source = l.cluster_id AND tdot.target = r.cluster_id
  LEFT JOIN tlen ls ON ls.cluster_id = l.cluster_id LEFT JOIN tlen rs ON rs.cluster_id = r.cluster_id),
pairs AS MATERIALIZED (SELECT *, chain >= 0.42 AS event_chain, (emb_sim >= 0.75 OR chain >= 0.42 OR n_shared >= 2 OR (emb_sim >= 0.65 AND n_shared >= 1)) AS admitted
  FROM (SELECT *, CASE WHEN compatible THEN {B.clamp('1 - abs(l_age - r_age) / 96')} ELSE 0.0 END AS chain FROM raw_pairs))"""
PAIRS = [*NODES, _PAIR_SQL]
_EDGES = f"""scored AS (SELECT *, {B.clamp("least(1.0, greatest(0.0, (emb_sim - 0.55) / 0.45)) * 0.40 + CASE WHEN n_shared >= 1 THEN 0.30 + least(n_shared - 1, 2) * 0.06 ELSE 0 END + chain * 0.12 + topic_sim * 0.10")} AS raw FROM pairs WHERE admitted),
edges AS (SELECT graph_id, source, target, CASE WHEN n_shared >= 1 THEN 'shared-entity' WHEN event_chain THEN 'event-chain' WHEN emb_sim >= 0.55 THEN 'embedding-similarity' ELSE 'market-adjacency' END AS edge_type,
  round_even(raw, 6) AS score, round_even(emb_sim, 6) AS embedding_similarity, event_chain, round_even(topic_sim, 6) AS topic_similarity, names FROM scored WHERE raw > 0),
top_edges AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY score DESC, {B.lookup(K.EDGE_PRIORITY, 'edge_type', '0')} DESC, source, target) AS pos FROM edges QUALIFY pos <= 100)"""
EDGES = [*PAIRS, _EDGES]


def pairs_of(spark, sf):
    return G.pair_scores(graph_nodes(spark, sf))


def edges_of(spark, sf):
    return G.relationship_edges(pairs_of(spark, sf))


@query(
    "k23_cluster_nodes",
    B.with_(*NODES) + "SELECT n.graph_id, n.cluster_id, n.coverage, n.sources, n.top_score, round(n.age_hours, 6) AS age_hours, n.dominant_topic, n.dominant_event_type, round(n.velocity, 6) AS velocity, n.pulsing, "
    "(SELECT string_agg(entity, '|' ORDER BY pos) FROM cents x WHERE x.cluster_id = n.cluster_id) AS entities FROM nodes n",
)
def k23(spark, sf):
    return graph_nodes(spark, sf).select(
        "graph_id", "cluster_id", c("coverage_count").alias("coverage"), c("sources_count").alias("sources"), c("max_score").alias("top_score"),
        F.round("age_hours", 6).alias("age_hours"), "dominant_topic", "dominant_event_type", F.round("velocity", 6).alias("velocity"), "pulsing",
        F.when(F.size("entities") > 0, F.array_join("entities", "|")).alias("entities"),
    )


@query(
    "j05_cluster_pairs",
    B.with_(*PAIRS) + "SELECT graph_id, source, target, n_shared, round(emb_sim, 6) AS emb_sim, round(topic_sim, 6) AS topic_sim FROM pairs",
)
def j05(spark, sf):
    return pairs_of(spark, sf).select(
        *G.EDGE, "n_shared", F.round("emb_sim", 6).alias("emb_sim"), F.round("topic_sim", 6).alias("topic_sim")
    )


@query(
    "j06_event_chains",
    B.with_(*PAIRS) + "SELECT graph_id, source, target, round(chain, 6) AS chain FROM pairs WHERE chain > 0",
)
def j06(spark, sf):
    return pairs_of(spark, sf).filter("chain > 0").select(*G.EDGE, F.round("chain", 6).alias("chain"))


@query(
    "k10_relationship_edges",
    B.with_(*EDGES) + """SELECT graph_id, source, target, edge_type, score, embedding_similarity, event_chain, topic_similarity, pos, coalesce(names, '') AS shared,
 array_to_string(list_filter([CASE WHEN embedding_similarity > 0 THEN 'Embedding similarity ' || printf('%.0f', round_even(embedding_similarity * 100, 0)) || '%' END,
 CASE WHEN names IS NOT NULL THEN 'Shared entities: ' || names END, CASE WHEN event_chain THEN 'Event chain evidence' END,
 CASE WHEN topic_similarity > 0 THEN 'Topic similarity ' || printf('%.0f', round_even(topic_similarity * 100, 0)) || '%' END], lambda x: x IS NOT NULL), '; ') AS evidence FROM top_edges""",
)
def k10(spark, sf):
    return edges_of(spark, sf).select(
        *G.EDGE, "edge_type", "score", "embedding_similarity", "event_chain", "topic_similarity", "pos",
        F.array_join("shared", ", ").alias("shared"), F.array_join("evidence", "; ").alias("evidence"),
    )


_SECOND = """second AS (SELECT graph_id, source, target, CASE WHEN lt = rt AND lt <> 'mixed' AND n_shared = 0 THEN 'same_topic_no_entities'
  WHEN n_shared >= 1 AND emb_sim < 0.55 THEN 'shared_entity_low_embedding' WHEN l_age < 48 AND l_cov >= 3 AND r_age < 48 AND r_cov >= 3 THEN 'both_hot'
  WHEN lt <> rt AND lt <> 'mixed' AND rt <> 'mixed' AND compatible AND least(l_age, r_age) < 72 THEN 'cross_topic_event_chain'
  WHEN lt <> rt AND lt <> 'mixed' AND rt <> 'mixed' AND l_cov >= 5 AND r_cov >= 5 AND abs(l_age - r_age) < 48 AND topic_sim >= 0.15 THEN 'cross_topic_high_coverage'
  WHEN lt <> rt AND lt <> 'mixed' AND rt <> 'mixed' AND emb_sim >= 0.45 AND emb_sim < 0.55 AND least(l_age, r_age) < 72 THEN 'cross_topic_embedding_near_miss' END AS reason
  FROM pairs WHERE NOT admitted)"""


@query("k11_second_look", B.with_(*PAIRS, _SECOND) + "SELECT graph_id, source, target, reason FROM second WHERE reason IS NOT NULL")
def k11(spark, sf):
    return G.second_look(pairs_of(spark, sf)).select(*G.EDGE, "reason")


# Landed verdicts: every third pair of a graph, the ends swapped half of the time.
_H = "(CAST('0x' || substr(md5(source || target), 1, 6) AS BIGINT))"
_VERD = f"""verd AS MATERIALIZED (SELECT graph_id, source, target, {B.pick(['follow-up', 'reaction', 'competing', 'unrelated'], _H)} AS label, ({_H} % 100) / 100.0 AS confidence FROM pairs WHERE {_H} % 3 = 0)"""


def verdict_rows(pairs):
    h = F.conv(F.substring(F.md5(F.concat("source", "target")), 1, 6), 16, 10).cast("long")
    rows = pairs.select(*G.EDGE, h.alias("h")).filter(F.pmod("h", F.lit(3)) == 0)
    swap = F.pmod("h", F.lit(2)) == 0
    ends = [F.when(swap, c("target")).otherwise(c("source")).alias("source"), F.when(swap, c("source")).otherwise(c("target")).alias("target")]
    last = rows.select(
        "graph_id", *ends, D.pick(["follow-up", "reaction", "competing", "unrelated"], c("h")).alias("label"), (F.pmod("h", F.lit(100)) / 100.0).alias("confidence"),
        F.lit("seen together").alias("explanation"), F.lit(2).alias("reply_no"),
    )
    # an earlier reply for every second pair, ends the other way round: the last one counts
    earlier = rows.filter(swap).select("graph_id", "source", "target", F.lit("unrelated").alias("label"), F.lit(0.99).alias("confidence"), F.lit("withdrawn").alias("explanation"), F.lit(1).alias("reply_no"))
    return last.unionByName(earlier)


_FLOOR = B.lookup(K.VERDICT_FLOORS, "label", "0.25")
_FUSED = f"""fz AS (SELECT coalesce(e.graph_id, v.graph_id) AS graph_id, coalesce(e.source, v.source) AS source, coalesce(e.target, v.target) AS target, e.edge_type, e.score, label, confidence,
  e.source IS NOT NULL AS known, confidence * 0.70 + {_FLOOR} * 0.30 AS derived FROM top_edges e FULL JOIN verd v ON e.graph_id = v.graph_id AND e.source = v.source AND e.target = v.target),
fused AS (SELECT graph_id, source, target, CASE WHEN NOT known OR (label <> 'unrelated' AND confidence >= 0.5) THEN label ELSE edge_type END AS edge_type,
  CASE WHEN NOT known THEN round_even(derived, 6) WHEN label = 'unrelated' AND confidence >= 0.7 THEN round_even(score * 0.6, 6)
   WHEN label <> 'unrelated' AND derived > score THEN round_even(derived, 6) ELSE score END AS score FROM fz WHERE known OR (label <> 'unrelated' AND confidence >= 0.6))"""
_FUSED_TOP = f"SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY score DESC, {B.lookup(K.EDGE_PRIORITY, 'edge_type', '0')} DESC, source, target) AS pos FROM fused QUALIFY pos <= 100"


@query("k13_verdict_fusion", B.with_(*EDGES, _VERD, _FUSED) + _FUSED_TOP)
def k13(spark, sf):
    pairs = pairs_of(spark, sf)
    return G.fuse_verdicts(G.relationship_edges(pairs), verdict_rows(pairs)).select(*G.EDGE, "edge_type", "score", "pos")


@query(
    "j12_verdict_join",
    B.with_(*EDGES, _VERD) + "SELECT graph_id, source, target, label, round(confidence, 6) AS confidence FROM top_edges JOIN verd USING (graph_id, source, target)",
)
def j12(spark, sf):
    pairs = pairs_of(spark, sf)
    keyed = G.latest_verdicts(verdict_rows(pairs)).select(*G.EDGE, "label", F.round("confidence", 6).alias("confidence"))
    return G.relationship_edges(pairs).select(*G.EDGE).join(keyed, G.EDGE)


@query(
    "k14_prompt_batches",
    B.with_(*PAIRS, _SECOND, _VERD) + """, cand AS (SELECT s.* FROM second s WHERE reason IS NOT NULL AND (graph_id, source, target) NOT IN (SELECT (graph_id, source, target) FROM verd)),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY source, target) - 1 AS at0 FROM cand),
 ents AS (SELECT cluster_id, string_agg(entity, ', ' ORDER BY pos) FILTER (pos <= 3) AS e3 FROM cents GROUP BY 1),
 blocks AS (SELECT n.cluster_id, '  Headline: ' || a.title || chr(10) || '  Summary: ' || substr(a.text, 1, 200) || CASE WHEN e3 IS NOT NULL THEN chr(10) || '  Entities: ' || e3 ELSE '' END
  || chr(10) || '  Event: ' || n.dominant_event_type || ' | Topic: ' || n.dominant_topic AS block FROM nodes n JOIN articles a ON a.article_id = n.top_article LEFT JOIN ents ON ents.cluster_id = n.cluster_id)
SELECT graph_id, CAST(floor(at0 / 15) AS INTEGER) AS batch, count(*) AS pairs, md5(string_agg('Pair ' || (at0 % 15 + 1) || ':' || chr(10) || 'A:' || chr(10) || x.block || chr(10) || 'B:' || chr(10) || y.block, chr(10) || chr(10) ORDER BY at0)) AS prompt_md5
FROM numbered JOIN blocks x ON x.cluster_id = source JOIN blocks y ON y.cluster_id = target GROUP BY ALL""",
)
def k14(spark, sf):
    nodes = graph_nodes(spark, sf)
    pairs = G.pair_scores(nodes)
    landed = verdict_rows(pairs).withColumn("pair_key", G.pair_key(c("source"), c("target")))
    return G.pair_batches(G.second_look(pairs), nodes, landed).select("graph_id", "batch", "pairs", F.md5("prompt").alias("prompt_md5"))


_OBJ = "'{\"pair\": ' || (1 + event_id % 3) || ', \"label\": \"' || " + B.pick(["Follow-Up", "reaction", "rivals", "competing"], "event_id") + " || '\", \"confidence\": ' || (user_id % 13) / 10.0 || ', \"explanation\": \"e' || event_id || '\"}'"


@query(
    "k15_verdict_replies",
    f"""SELECT event_id, 1 + event_id % 3 AS pair, CASE {B.pick(["follow-up", "reaction", "rivals", "competing"], "event_id")} WHEN 'rivals' THEN 'unrelated' ELSE {B.pick(["follow-up", "reaction", "rivals", "competing"], "event_id")} END AS label,
 least(1.0, (user_id % 13) / 10.0) AS confidence, 'e' || event_id AS explanation FROM events""",
)
def k15(spark, sf):
    e = c("event_id")
    body = F.concat(
        F.lit('{"pair": '), (1 + F.pmod(e, F.lit(3))).cast("string"), F.lit(', "label": "'), D.pick(["Follow-Up", "reaction", "rivals", "competing"], e),
        F.lit('", "confidence": '), (F.pmod("user_id", F.lit(13)) / 10.0).cast("string"), F.lit(', "explanation": "e'), e.cast("string"), F.lit('"}'),
    )
    reply = (
        F.when(e % 4 == 0, F.concat(F.lit("["), body, F.lit("]")))
        .when(e % 4 == 1, F.concat(F.lit('{"results": ['), body, F.lit("]}")))
        .when(e % 4 == 2, body)
        .otherwise(F.concat(F.lit("```json\n["), body, F.lit("]\n```")))
    )
    return table(spark, sf, "events").select("event_id", F.explode(G.parse_pair_reply(reply)).alias("v")).select("event_id", "v.*")


_CLIENT = f"""ccand AS (SELECT graph_id, source, target, n_shared, event_chain, topic_sim AS adjacency FROM pairs WHERE n_shared >= 1 OR topic_sim >= 0.46 OR chain >= 0.42),
cedges AS (SELECT graph_id, source, target, CASE WHEN n_shared > 0 THEN 'shared-entity' WHEN event_chain THEN 'event-chain' ELSE 'market-adjacency' END AS edge_type,
  {B.clamp("CASE WHEN n_shared > 0 THEN 0.58 + least(n_shared - 1, 2) * 0.12 ELSE 0 END + CASE WHEN event_chain THEN 0.24 ELSE 0 END + adjacency * 0.18")} AS score FROM ccand)"""


@query("k16_client_candidates", B.with_(*PAIRS, _CLIENT) + "SELECT graph_id, source, target, event_chain, round(adjacency, 6) AS adjacency FROM ccand")
def k16(spark, sf):
    return G.client_candidates(pairs_of(spark, sf)).select(*G.EDGE, "event_chain", F.round("adjacency", 6).alias("adjacency"))


@query("k17_client_edges", B.with_(*PAIRS, _CLIENT) + "SELECT graph_id, source, target, edge_type, round(score, 6) AS score FROM cedges")
def k17(spark, sf):
    found = G.client_candidates(pairs_of(spark, sf))
    # Candidates arrive from several passes: the same pairs with their ends swapped change nothing.
    swapped = found.select("graph_id", c("target").alias("source"), c("source").alias("target"), "shared", "event_chain", "adjacency")
    return G.client_edges(found.unionByName(swapped)).select(*G.EDGE, "edge_type", F.round("score", 6).alias("score"))


_IMPORTANCE = """imp0 AS (SELECT *, coverage * 1.8 + top_score * 0.72 + sources * 1.2 + velocity * 2.8 + CASE WHEN pulsing THEN 16 ELSE 0 END AS raw_imp FROM nodes),
imp AS (SELECT *, least(1.0, raw_imp / max(raw_imp) OVER (PARTITION BY graph_id)) AS importance FROM imp0)"""
_VISIBLE = f"""ranked AS (SELECT graph_id, source, target, edge_type, score, row_number() OVER (PARTITION BY graph_id ORDER BY score DESC, {B.lookup(K.CLIENT_EDGE_PRIORITY, 'edge_type', '0')} DESC, source, target) AS rk FROM top_edges),
leaders AS (SELECT graph_id, cluster_id, row_number() OVER (PARTITION BY graph_id ORDER BY importance DESC, coverage DESC, cluster_id) AS ld FROM imp WHERE importance >= 0.72 QUALIFY ld <= 2),
one AS (SELECT l.graph_id, min(rk) AS rk FROM leaders l JOIN ranked r ON r.graph_id = l.graph_id AND l.cluster_id IN (r.source, r.target) WHERE ld = 1 GROUP BY 1),
two AS (SELECT l.graph_id, min(r.rk) AS rk FROM leaders l JOIN ranked r ON r.graph_id = l.graph_id AND l.cluster_id IN (r.source, r.target) LEFT JOIN one o ON o.graph_id = l.graph_id
  WHERE ld = 2 AND r.rk IS DISTINCT FROM o.rk GROUP BY 1),
quota AS (SELECT graph_id, least(greatest(8, CAST(floor(count(*) * 0.3 + 0.5) AS INTEGER)), 14) AS q FROM nodes GROUP BY 1),
placed AS (SELECT r.*, q, row_number() OVER (PARTITION BY r.graph_id ORDER BY CASE WHEN r.rk = one.rk OR r.rk = two.rk THEN 0 ELSE 1 END, r.rk) AS place
  FROM ranked r JOIN quota USING (graph_id) LEFT JOIN one ON one.graph_id = r.graph_id LEFT JOIN two ON two.graph_id = r.graph_id)"""


@query("k18_visible_edges", B.with_(*EDGES, _IMPORTANCE, _VISIBLE) + "SELECT graph_id, source, target, rk AS pos, place > q AS hidden FROM placed")
def k18(spark, sf):
    nodes = G.node_importance(graph_nodes(spark, sf))
    return G.visible_edges(G.relationship_edges(G.pair_scores(nodes)), nodes).select(*G.EDGE, "pos", "hidden")


@query(
    "k19_neighbourhoods",
    B.with_(*EDGES) + f""", ends AS (SELECT graph_id, source, target, edge_type, score, unnest([source, target]) AS node FROM top_edges)
SELECT graph_id, node, source, target, row_number() OVER (PARTITION BY graph_id, node ORDER BY score DESC, {B.lookup(K.CLIENT_EDGE_PRIORITY, 'edge_type', '0')} DESC, source, target) AS pos FROM ends QUALIFY pos <= 4""",
)
def k19(spark, sf):
    return G.neighbourhoods(edges_of(spark, sf)).select("graph_id", "node", "source", "target", "pos")


@query("k20_node_importance", B.with_(*NODES, _IMPORTANCE) + "SELECT graph_id, cluster_id, round(importance, 6) AS importance FROM imp")
def k20(spark, sf):
    return G.node_importance(graph_nodes(spark, sf)).select("graph_id", "cluster_id", F.round("importance", 6).alias("importance"))


@query(
    "k21_label_choice",
    B.with_(*NODES, _IMPORTANCE) + """, pri AS (SELECT *, round(round(importance * 1000 + coverage * 8 + sources * 4 + velocity * 6 + top_score * 0.5, 3) + coverage * 2, 3) AS p, count(*) OVER (PARTITION BY graph_id) AS n FROM imp),
 pl AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY importance >= 0.82 DESC, p DESC, cluster_id) AS place FROM pri)
SELECT graph_id, cluster_id, importance >= 0.82 OR place <= greatest(2, ceil(n * 0.25)) AS overview, importance >= 0.82 OR place <= greatest(4, ceil(n * 0.5)) AS cluster FROM pl""",
)
def k21(spark, sf):
    nodes = G.node_importance(graph_nodes(spark, sf))
    a = G.label_choice(nodes, "overview").select(*nodes.columns, c("labelled").alias("overview"))
    return G.label_choice(a, "cluster").select("graph_id", "cluster_id", "overview", c("labelled").alias("cluster"))


@query(
    "k22_node_details",
    B.with_(*EDGES) + """, ends AS (SELECT graph_id, edge_type, score, unnest([source, target]) AS node FROM top_edges),
 best AS (SELECT n.cluster_id AS node, string_agg(article_id::VARCHAR, ',' ORDER BY pos) AS articles FROM nodes n JOIN (SELECT cluster_id, article_id, row_number() OVER (PARTITION BY cluster_id ORDER BY global_score DESC, article_id) AS pos FROM members QUALIFY pos <= 6) m USING (cluster_id) GROUP BY 1)
SELECT graph_id, node, edge_type, count(*) AS edges, round(avg(score), 4) AS mean_score, any_value(articles) AS articles FROM ends JOIN best USING (node) GROUP BY ALL""",
)
def k22(spark, sf):
    nodes = graph_nodes(spark, sf)
    grouped, top = G.node_details(G.relationship_edges(G.pair_scores(nodes)), nodes, graph_articles(spark, sf))
    ids = F.array_sort(F.collect_list(F.struct("pos", c("article_id").cast("string").alias("id"))))
    listed = top.groupBy(c("cluster_id").alias("node")).agg(F.array_join(F.transform(ids, lambda x: x["id"]), ",").alias("articles"))
    return grouped.join(listed, "node").select("graph_id", "node", "edge_type", "edges", F.round("mean_score", 4).alias("mean_score"), "articles")


@query(
    "k08_set_key",
    B.with_(*NODES) + "SELECT graph_id, sha256(string_agg(cluster_id, ',' ORDER BY cluster_id)) AS set_key, md5(string_agg(cluster_id || ':' || coverage || ':' || epoch_us(last_seen), '|' ORDER BY cluster_id || ':' || coverage || ':' || epoch_us(last_seen))) AS fingerprint FROM nodes GROUP BY 1",
)
def k08(spark, sf):
    return G.set_key(graph_nodes(spark, sf))


_ODD = B.pick(["follow-up", "reaction", "competing", "unrelated"], _H)


@query(
    "e06_edge_recall",
    B.with_(*EDGES) + f""", lab AS (SELECT p.graph_id, p.source, p.target, {_ODD.replace('source', 'p.source').replace('target', 'p.target')} AS label, e.source IS NOT NULL AS hit FROM pairs p LEFT JOIN top_edges e ON e.graph_id = p.graph_id AND e.source = p.source AND e.target = p.target),
 by_label AS (SELECT label, count(*) AS pairs, count(*) FILTER (hit) AS with_edge FROM lab GROUP BY 1)
SELECT label, pairs, with_edge, round(with_edge / pairs, 4) AS rate, round(sum(with_edge) FILTER (label <> 'unrelated') OVER () / sum(pairs) FILTER (label <> 'unrelated') OVER (), 4) AS recall,
 round(sum(with_edge) FILTER (label <> 'unrelated') OVER () / sum(with_edge) OVER (), 4) AS precision FROM by_label""",
)
def e06(spark, sf):
    pairs = pairs_of(spark, sf)
    h = F.conv(F.substring(F.md5(F.concat("source", "target")), 1, 6), 16, 10).cast("long")
    labelled = pairs.select(*G.EDGE, D.pick(["follow-up", "reaction", "competing", "unrelated"], h).alias("label"))
    return G.edge_recall(labelled, G.relationship_edges(pairs))
