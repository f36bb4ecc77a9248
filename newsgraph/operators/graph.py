"""Relationships between story clusters: nodes, edges, second looks, verdict fusion and views.

A graph is a snapshot of at most MAX_NODES leading clusters (``graph_id``), so pairs are formed inside
a bounded group whatever the number of clusters; the number of graphs grows with the data instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgraph import constants as K
from newsgraph.functions import features as FT, maps, scoring as S
from newsgraph.operators import aggregates as AG, vectors as V
from newsgraph.operators.ranking import top_per_group
from newsgraph.session import cut_lineage

MAX_NODES = 80
MAX_EDGES = 100
EDGE = ["graph_id", "source", "target"]
c = F.col
r = maps.round_half_even


def leading_clusters(stats: DataFrame, limit: int = MAX_NODES) -> DataFrame:
    return top_per_group(stats, ["graph_id"], [F.desc("max_score"), F.asc("cluster_id")], limit)


def cluster_nodes(articles: DataFrame, vectors: DataFrame, graph_of: Column, canon: DataFrame | None = None) -> DataFrame:
    """Node rows: statistics, dominant topic and event type, entities, span, headline, summary, centroid.

    Only the leading clusters of each graph are described: the heavy columns join after the cut.
    """
    stats = AG.with_velocity(
        leading_clusters(AG.cluster_stats(articles).withColumn("graph_id", graph_of)), ["graph_id"]
    )
    kept = articles.join(stats.select("cluster_id"), "cluster_id", "left_semi")
    topics = AG.dominant_topic(kept)
    events = AG.dominant_event_type(kept, "cluster_id", "event_type")
    named = AG.cluster_entities(kept, canon)
    # At most five entities per cluster.
    entities = named.groupBy("cluster_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda e: e["name"]).alias("entities")
    )
    means = V.mean_vectors(kept.select("article_id", "cluster_id").join(vectors.select("article_id", "embedding"), "article_id"), "cluster_id", "embedding")
    empty = F.array().cast("array<string>")
    return (
        stats.join(topics, "cluster_id", "left")
        .join(events, "cluster_id", "left")
        .join(entities, "cluster_id", "left")
        .join(means.select("cluster_id", c("embedding").alias("centroid")), "cluster_id", "left")
        .withColumn("entities", F.coalesce("entities", empty))
        .withColumn("dominant_event_type", F.coalesce("dominant_event_type", F.lit("MIXED")))
    )


# --- pair scores ------------------------------------------------------------------------------


def _entity_map(names: Column) -> Column:
    pairs = F.filter(F.transform(names, lambda n: F.struct(FT.entity_key(n).alias("k"), n.alias("n"))), lambda p: p["k"] != "")
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["n"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def _unit(vector: Column) -> Column:
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return maps.let(length, lambda n: F.when(n > 0, F.transform(vector, lambda x: x / n)))


def prepare(nodes: DataFrame) -> DataFrame:
    """Columns that pairs need, computed once per node.  Materialised by the caller when reused."""
    return nodes.select(
        "graph_id", c("cluster_id").cast("string").alias("id"),
        _entity_map(c("entities")).alias("ent"),
        FT.event_family(c("dominant_event_type")).alias("family"),
        "dominant_topic", "topic_weights", c("age_hours").cast("double").alias("age"),
        c("coverage_count").cast("int").alias("coverage"),
        F.when(c("centroid").isNotNull(), _unit(c("centroid"))).alias("unit"),
    )


def pair_scores(nodes: DataFrame) -> DataFrame:
    """Scores of all pairs of nodes of one graph.  How many nodes a graph has is for the caller to bound."""
    ready = prepare(nodes)
    left, right = ready.alias("l"), ready.alias("r")
    pairs = left.join(right, (c("l.graph_id") == c("r.graph_id")) & (c("l.id") < c("r.id")))
    shared_keys = F.array_intersect(F.map_keys("l.ent"), F.map_keys("r.ent"))
    shared = F.array_sort(F.transform(shared_keys, lambda k: F.element_at(c("l.ent"), k)))
    sim = F.aggregate(F.zip_with("l.unit", "r.unit", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    forward = F.concat_ws(":", "l.family", "r.family")
    backward = F.concat_ws(":", "r.family", "l.family")
    compatible = forward.isin(K.CHAINED_FAMILIES) | backward.isin(K.CHAINED_FAMILIES)
    gap = F.abs(c("l.age") - c("r.age"))
    keys = F.array_sort(F.array_union(F.map_keys("l.topic_weights"), F.map_keys("r.topic_weights")))
    at = lambda side, k: F.coalesce(F.try_element_at(c(f"{side}.topic_weights"), k), F.lit(0.0))
    add = lambda f: F.aggregate(keys, F.lit(0.0), lambda a, k: a + f(k))
    dot = add(lambda k: at("l", k) * at("r", k))
    size = F.sqrt(add(lambda k: at("l", k) * at("l", k)) * add(lambda k: at("r", k) * at("r", k)))
    cosine = F.when(size > 0, dot / size).otherwise(0.0)
    same = c("l.dominant_topic") == c("r.dominant_topic")
    side = lambda name: [c(f"l.{name}").alias(f"l_{name}"), c(f"r.{name}").alias(f"r_{name}")]
    scored = pairs.select(
        c("l.graph_id").alias("graph_id"), c("l.id").alias("source"), c("r.id").alias("target"),
        shared.alias("shared"),
        F.when(c("l.unit").isNotNull() & c("r.unit").isNotNull(), sim).otherwise(0.0).alias("emb_sim"),
        F.when(compatible, S.clamp(1.0 - gap / 96.0)).otherwise(0.0).alias("chain"),
        compatible.alias("compatible"),
        S.clamp(cosine + F.when(same, 0.12).otherwise(0.0)).alias("topic_sim"),
        *side("dominant_topic"), *side("age"), *side("coverage"),
    )
    return scored.withColumn("event_chain", c("chain") >= 0.42).withColumn("n_shared", F.size("shared"))


def admitted() -> Column:
    strong = (c("emb_sim") >= 0.75) | c("event_chain") | (c("n_shared") >= 2)
    return strong | ((c("emb_sim") >= 0.65) & (c("n_shared") >= 1))


def _ordered(edges: DataFrame, limit: int, priorities: dict = K.EDGE_PRIORITY, score: str = "score") -> DataFrame:
    rank = maps.lookup(priorities, c("edge_type"), 0)
    order = [F.desc(score), rank.desc(), F.asc("source"), F.asc("target")]
    return top_per_group(edges, ["graph_id"], order, limit, "pos")


def relationship_edges(pairs: DataFrame, limit: int = MAX_EDGES) -> DataFrame:
    n = c("n_shared")
    combined = S.clamp(
        S.clamp((c("emb_sim") - 0.55) / 0.45) * 0.40
        + F.when(n >= 1, 0.30 + F.least(n - 1, F.lit(2)) * 0.06).otherwise(0.0)
        + F.least(c("chain"), F.lit(1.0)) * 0.12
        + S.clamp(c("topic_sim")) * 0.10
    )
    kind = (
        F.when(n >= 1, "shared-entity")
        .when(c("event_chain"), "event-chain")
        .when(c("emb_sim") >= 0.55, "embedding-similarity")
        .otherwise("market-adjacency")
    )
    percent = lambda x: F.format_string("%.0f%%", F.rint(x * 100))
    evidence = F.array_compact(
        F.array(
            F.when(c("emb_sim") > 0, F.concat(F.lit("Embedding similarity "), percent(c("emb_sim")))),
            F.when(n >= 1, F.concat(F.lit("Shared entities: "), F.array_join("shared", ", "))),
            F.when(c("event_chain"), F.lit("Event chain evidence")),
            F.when(c("topic_sim") > 0, F.concat(F.lit("Topic similarity "), percent(S.clamp(c("topic_sim"))))),
        )
    )
    edges = pairs.filter(admitted()).withColumn("_raw", combined).filter(c("_raw") > 0)
    edges = edges.select(
        *EDGE, kind.alias("edge_type"), r(c("_raw"), 6).alias("score"), r(c("emb_sim"), 6).alias("embedding_similarity"),
        "shared", "event_chain", r(c("topic_sim"), 6).alias("topic_similarity"), evidence.alias("evidence"),
    )
    return _ordered(edges, limit)


def second_look(pairs: DataFrame) -> DataFrame:
    """Pairs not admitted as edges that deserve a second look, with the reason."""
    lt, rt = c("l_dominant_topic"), c("r_dominant_topic")
    cross = (lt != rt) & (lt != "mixed") & (rt != "mixed")
    hot = lambda s: (c(f"{s}_age") < 48) & (c(f"{s}_coverage") >= 3)
    youngest = F.least("l_age", "r_age")
    reason = (
        F.when((lt == rt) & (lt != "mixed") & (c("n_shared") == 0), "same_topic_no_entities")
        .when((c("n_shared") >= 1) & (c("emb_sim") < 0.55), "shared_entity_low_embedding")
        .when(hot("l") & hot("r"), "both_hot")
        .when(cross & c("compatible") & (youngest < 72), "cross_topic_event_chain")
        .when(
            cross & (c("l_coverage") >= 5) & (c("r_coverage") >= 5) & (F.abs(c("l_age") - c("r_age")) < 48)
            & (c("topic_sim") >= 0.15),
            "cross_topic_high_coverage",
        )
        .when(cross & c("emb_sim").between(0.45, 0.55) & (c("emb_sim") < 0.55) & (youngest < 72), "cross_topic_embedding_near_miss")
    )
    return pairs.filter(~admitted()).withColumn("reason", reason).filter(c("reason").isNotNull())


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """One verdict per unordered pair: the one of the last reply (``reply_no``; of equals the later by label)."""
    said = F.struct(c("label").alias("label"), c("confidence").cast("double").alias("confidence"), c("explanation").alias("explanation"))
    keyed = verdicts.select("graph_id", F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), said.alias("v"), "reply_no")
    return keyed.groupBy(*EDGE).agg(F.max_by("v", F.struct("reply_no", "v")).alias("v")).select(*EDGE, "v.*")


def fuse_verdicts(edges: DataFrame, verdicts: DataFrame, limit: int = MAX_EDGES) -> DataFrame:
    """Edges with landed verdicts applied: weaker if judged unrelated, stronger if confirmed, new if confident.

    Shared names and evidence of an edge stay; a related verdict adds itself to the evidence and brings its explanation.
    """
    keyed = latest_verdicts(verdicts)
    joined = edges.drop("pos").withColumn("_edge", F.lit(True)).join(keyed, EDGE, "full_outer")
    known = F.coalesce("_edge", F.lit(False))
    related = c("label").isNotNull() & (c("label") != "unrelated")
    derived = r(c("confidence") * 0.70 + maps.lookup(K.VERDICT_FLOORS, c("label"), 0.25) * 0.30, 6)
    raw = c("confidence") * 0.70 + maps.lookup(K.VERDICT_FLOORS, c("label"), 0.25) * 0.30
    score = (
        F.when(~known, derived)
        .when((c("label") == "unrelated") & (c("confidence") >= 0.7), r(c("score") * 0.6, 6))
        .when(related & (raw > c("score")), derived)
        .otherwise(c("score"))
    )
    kind = F.when(~known | (related & (c("confidence") >= 0.5)), c("label")).otherwise(c("edge_type"))
    kept = joined.filter(known | (related & (c("confidence") >= 0.6)))
    none = F.array().cast("array<string>")
    fused = kept.select(
        *EDGE, kind.alias("edge_type"), score.alias("score"),
        F.coalesce("embedding_similarity", F.lit(0.0)).alias("embedding_similarity"),
        F.coalesce("event_chain", F.lit(False)).alias("event_chain"),
        F.coalesce("topic_similarity", F.lit(0.0)).alias("topic_similarity"),
        F.when(related, c("label")).alias("verdict"),
        F.coalesce("shared", none).alias("shared"),
        F.concat(F.coalesce("evidence", none), F.when(related, F.array(F.format_string("Judged %s %.0f%%", c("label"), F.rint(c("confidence") * 100)))).otherwise(none)).alias("evidence"),
        F.when(related, c("explanation")).alias("explanation"),
    )
    return _ordered(fused, limit)


# --- client view ------------------------------------------------------------------------------


def client_candidates(pairs: DataFrame) -> DataFrame:
    keep = (c("n_shared") >= 1) | (c("topic_sim") >= 0.46) | (c("chain") >= 0.42)
    return pairs.filter(keep).select(*EDGE, "shared", "event_chain", c("topic_sim").alias("adjacency"))


def client_edges(candidates: DataFrame) -> DataFrame:
    """One edge per unordered pair: entities united, chain or-ed, adjacency maximised; then scored."""
    merged = (
        candidates.withColumn("_s", F.least("source", "target"))
        .withColumn("_t", F.greatest("source", "target"))
        .groupBy("graph_id", "_s", "_t")
        .agg(
            # Candidates of one pair come from a handful of passes; their entity lists hold at most five names.
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("shared")))).alias("shared"),
            F.bool_or("event_chain").alias("event_chain"),
            F.max("adjacency").alias("adjacency"),
        )
    )
    n = F.size(F.array_distinct(F.filter(F.transform("shared", FT.entity_key), lambda k: k != "")))
    score = S.clamp(
        F.when(n > 0, 0.58 + F.least(n - 1, F.lit(2)) * 0.12).otherwise(0.0)
        + F.when(c("event_chain"), 0.24).otherwise(0.0)
        + S.clamp(c("adjacency")) * 0.18
    )
    kind = F.when(F.size("shared") > 0, "shared-entity").when(c("event_chain"), "event-chain").otherwise("market-adjacency")
    return merged.select(
        "graph_id", c("_s").alias("source"), c("_t").alias("target"), kind.alias("edge_type"), score.alias("score")
    )


def node_importance(nodes: DataFrame) -> DataFrame:
    raw = (
        c("coverage_count") * 1.8 + c("max_score") * 0.72 + c("sources_count") * 1.2 + c("velocity") * 2.8
        + F.when(c("pulsing"), 16.0).otherwise(0.0)
    )
    top = nodes.groupBy("graph_id").agg(F.max(raw).alias("_top"))
    joined = nodes.join(top, "graph_id")
    return joined.withColumn(
        "importance", F.when(c("_top") <= 0, 0.0).otherwise(S.clamp(raw / c("_top")))
    ).drop("_top")


def _client_order() -> list[Column]:
    return [F.desc("score"), maps.lookup(K.CLIENT_EDGE_PRIORITY, c("edge_type"), 0).desc(), F.asc("source"), F.asc("target")]


def visible_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges shown by default: the best edge of each of the two leading nodes, then the best overall."""
    sizes = nodes.groupBy("graph_id").agg(F.count("*").alias("_nodes"))
    quota = F.least(F.greatest(F.lit(8), F.floor(c("_nodes") * 0.3 + 0.5).cast("int")), F.lit(14))
    leaders = top_per_group(
        nodes.filter(c("importance") >= 0.72).withColumn("node", c("cluster_id").cast("string")), ["graph_id"],
        [F.desc("importance"), F.desc("coverage_count"), F.asc("node")], 2, "_lead",
    ).select("graph_id", "node", "_lead")
    # Used three times below; as many edges as the caller gives.
    ranked = cut_lineage(
        edges.select(*EDGE, "edge_type", "score").withColumn("_rank", F.row_number().over(Window.partitionBy("graph_id").orderBy(*_client_order())))
    )
    touching = ranked.join(
        leaders, (ranked["graph_id"] == leaders["graph_id"]) & ((c("source") == c("node")) | (c("target") == c("node")))
    ).select(ranked["graph_id"], "_rank", "_lead")
    first = touching.filter("_lead = 1").groupBy("graph_id").agg(F.min("_rank").alias("_first"))
    second = (
        touching.filter("_lead = 2").join(first, "graph_id", "left")
        .filter(c("_first").isNull() | (c("_rank") != c("_first")))
        .groupBy("graph_id").agg(F.min("_rank").alias("_second"))
    )
    staged = ranked.join(first, "graph_id", "left").join(second, "graph_id", "left").join(sizes, "graph_id")
    lead = F.coalesce(c("_rank") == c("_first"), F.lit(False)) | F.coalesce(c("_rank") == c("_second"), F.lit(False))
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy(lead.desc(), "_rank"))
    return staged.withColumn("_place", place).select(
        *EDGE, "edge_type", "score", (c("_place") > quota).alias("hidden"), c("_rank").alias("pos")
    )


def neighbourhoods(edges: DataFrame, limit: int = 4) -> DataFrame:
    """Best edges of every node at once: (graph_id, node, source, target, pos)."""
    ends = edges.select(*EDGE, "edge_type", "score", F.explode(F.array("source", "target")).alias("node"))
    return top_per_group(ends, ["graph_id", "node"], _client_order(), limit, "pos")


def label_choice(nodes: DataFrame, zoom: str) -> DataFrame:
    """Nodes that carry a label at a zoom level; very important ones always do."""
    render = F.round(
        c("importance") * 1000 + c("coverage_count") * 8 + c("sources_count") * 4 + c("velocity") * 6 + c("max_score") * 0.5, 3
    )
    staged = nodes.withColumn("render_priority", render).withColumn(
        "label_priority", F.round(render + c("coverage_count") * 2, 3)
    )
    size = F.count("*").over(Window.partitionBy("graph_id"))
    quota = {
        "detail": size,
        "cluster": F.greatest(F.lit(4), F.ceil(size * 0.5)),
        "overview": F.greatest(F.lit(2), F.ceil(size * 0.25)),
    }[zoom]
    pinned = c("importance") >= 0.82
    by_priority = Window.partitionBy("graph_id").orderBy(pinned.desc(), F.desc("label_priority"), F.asc("cluster_id"))
    place = F.row_number().over(by_priority)
    return staged.withColumn("labelled", pinned | (place <= quota))


def node_details(edges: DataFrame, nodes: DataFrame, articles: DataFrame, best: int = 6) -> tuple[DataFrame, DataFrame]:
    """Per node and edge type: count and mean score; and the best articles of each node."""
    ends = edges.select("graph_id", "edge_type", "score", F.explode(F.array("source", "target")).alias("node"))
    grouped = ends.groupBy("graph_id", "node", "edge_type").agg(F.count("*").alias("edges"), F.avg("score").alias("mean_score"))
    kept = articles.join(nodes.select("cluster_id"), "cluster_id", "left_semi")
    top = top_per_group(kept, ["cluster_id"], [F.desc("global_score"), F.asc("article_id")], best, "pos")
    return grouped, top


def set_key(nodes: DataFrame) -> DataFrame:
    """Key of a set of clusters, whatever their order, and its change fingerprint (at most MAX_NODES per graph)."""
    ids = F.array_join(F.array_sort(F.collect_list(c("cluster_id").cast("string"))), ",")
    state = F.concat_ws(":", c("cluster_id").cast("string"), c("coverage_count").cast("string"), F.unix_micros("last_seen").cast("string"))
    return nodes.groupBy("graph_id").agg(
        F.sha2(ids, 256).alias("set_key"), F.md5(F.array_join(F.array_sort(F.collect_list(state)), "|")).alias("fingerprint")
    )


# --- prompts and replies ----------------------------------------------------------------------


def pair_key(a: Column, b: Column) -> Column:
    return F.concat(F.lit("rel_infer:"), F.substring(F.sha2(F.concat_ws("::", F.least(a, b), F.greatest(a, b)), 256), 1, 16))


def pair_batches(candidates: DataFrame, nodes: DataFrame, verdicts: DataFrame, size: int = 15) -> DataFrame:
    """Prompt text per batch of pairs without a landed verdict."""
    described = nodes.select(
        "graph_id", c("cluster_id").cast("string").alias("id"),
        F.concat_ws(
            "\n",
            F.concat(F.lit("  Headline: "), F.coalesce("headline", F.lit("Unknown"))),
            F.when(F.coalesce("top_summary", F.lit("")) != "", F.concat(F.lit("  Summary: "), F.substring("top_summary", 1, 200))),
            F.when(F.size("entities") > 0, F.concat(F.lit("  Entities: "), F.array_join(F.slice("entities", 1, 3), ", "))),
            F.concat(F.lit("  Event: "), c("dominant_event_type"), F.lit(" | Topic: "), c("dominant_topic")),
        ).alias("block"),
    )
    todo = candidates.withColumn("pair_key", pair_key(c("source"), c("target"))).join(
        verdicts.select("graph_id", "pair_key"), ["graph_id", "pair_key"], "left_anti"
    )
    # Pairs of one graph are bounded by MAX_NODES squared over two.
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy("source", "target")) - 1
    staged = todo.withColumn("_at", place).select(
        *EDGE, "pair_key", F.floor(c("_at") / size).cast("int").alias("batch"), (c("_at") % size + 1).cast("int").alias("index")
    )
    a, b = described.alias("a"), described.alias("b")
    joined = staged.alias("s").join(a, (c("s.graph_id") == c("a.graph_id")) & (c("s.source") == c("a.id"))).join(
        b, (c("s.graph_id") == c("b.graph_id")) & (c("s.target") == c("b.id"))
    )
    text = F.concat(
        F.lit("Pair "), c("s.index").cast("string"), F.lit(":\nA:\n"), c("a.block"), F.lit("\nB:\n"), c("b.block")
    )
    lines = F.array_sort(F.collect_list(F.struct(c("s.index").alias("i"), text.alias("t"))))
    return joined.groupBy(c("s.graph_id").alias("graph_id"), c("s.batch").alias("batch")).agg(
        F.count("*").alias("pairs"), F.array_join(F.transform(lines, lambda x: x["t"]), "\n\n").alias("prompt")
    )


def parse_pair_reply(reply: Column) -> Column:
    """Array of struct<pair, label, confidence, explanation> from a reply: a list, a wrapped list or one object."""
    item = "struct<pair:int,label:string,confidence:string,explanation:string>"
    plain = F.regexp_replace(F.regexp_replace(reply, r"(?m)^\s*```.*$", ""), r"^\s+|\s+$", "")
    wrapped = F.from_json(plain, f"results array<{item}>, pairs array<{item}>, relationships array<{item}>, data array<{item}>")
    one = F.from_json(plain, "pair int, label string, confidence string, explanation string")
    items = F.when(F.startswith(plain, F.lit("[")), F.from_json(plain, f"array<{item}>")).otherwise(
        F.coalesce(wrapped["results"], wrapped["pairs"], wrapped["relationships"], wrapped["data"], F.array(one))
    )

    def clean(x: Column) -> Column:
        label = F.lower(F.trim(F.coalesce(x["label"], F.lit("unrelated"))))
        confidence = F.when(x["confidence"].isNull(), F.lit(0.5)).otherwise(
            F.coalesce(S.clamp(x["confidence"].try_cast("double")), F.lit(0.5))
        )
        return F.struct(
            x["pair"].alias("pair"),
            F.when(label.isin("follow-up", "reaction", "competing", "unrelated"), label).otherwise("unrelated").alias("label"),
            confidence.alias("confidence"),
            F.substring(F.coalesce(x["explanation"], F.lit("")), 1, 200).alias("explanation"),
        )

    return F.transform(F.filter(items, lambda x: x["pair"].isNotNull()), clean)


def edge_recall(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of labelled pairs that got an edge, per label, with overall recall and precision."""
    hit = pairs.join(edges.select(*EDGE).withColumn("_e", F.lit(True)), EDGE, "left").withColumn("_e", F.coalesce("_e", F.lit(False)))
    by = hit.groupBy("label").agg(F.count("*").alias("pairs"), F.count_if("_e").alias("with_edge"))
    related = F.when(c("label") != "unrelated", c("pairs"))
    found = F.when(c("label") != "unrelated", c("with_edge"))
    every = Window.partitionBy()
    return by.select(
        "label", "pairs", "with_edge", F.round(c("with_edge") / c("pairs"), 4).alias("rate"),
        F.round(F.coalesce(F.try_divide(F.sum(found).over(every), F.sum(related).over(every)), F.lit(0.0)), 4).alias("recall"),
        F.round(F.coalesce(F.try_divide(F.sum(found).over(every), F.sum("with_edge").over(every)), F.lit(0.0)), 4).alias("precision"),
    )


