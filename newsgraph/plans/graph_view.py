"""The cluster graph response: node fields with plane coordinates, fused edges and best articles per node."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsgraph.operators import graph as G, vectors as V
from newsgraph.operators.ranking import top_per_group
from newsgraph.session import cut_lineage


def graph_view(nodes: DataFrame, verdicts_of, articles: DataFrame | None = None, listed: int = 6) -> DataFrame:
    """One row per node: age, importance, position, pulsing, its fused edges best first, and its best articles.

    ``links`` holds (other, edge_type, score, evidence, explanation) of at most the edges that the fusion keeps a graph.
    Positions are fitted by graph.  ``articles`` (article_id, cluster_id, global_score) fills ``articles``.
    """
    c = F.col
    placed = V.planes(nodes.filter(c("centroid").isNotNull()), "graph_id", "cluster_id", "centroid")
    pairs = cut_lineage(G.pair_scores(nodes))
    fused = G.fuse_verdicts(G.relationship_edges(pairs), verdicts_of(pairs))
    ends = fused.select("graph_id", F.explode(F.array(
        F.struct(c("source").alias("node"), c("target").alias("other")), F.struct(c("target").alias("node"), c("source").alias("other")))).alias("e"),
        "edge_type", "score", "evidence", "explanation")
    link = F.struct((-c("score")).alias("order"), c("e.other").alias("other"), "edge_type", "score", "evidence", "explanation")
    linked = ends.groupBy("graph_id", c("e.node").alias("cluster_id")).agg(
        F.count("*").alias("edges"), F.max("score").alias("best_edge"), F.array_sort(F.collect_list(link)).alias("links"))
    rows = G.node_importance(nodes).join(placed, ["graph_id", "cluster_id"], "left").join(linked, ["graph_id", "cluster_id"], "left").join(G.set_key(nodes), "graph_id")
    if articles is not None:
        members = articles.join(nodes.select("cluster_id"), "cluster_id", "left_semi")
        top = top_per_group(members.select("cluster_id", "article_id", "global_score"), ["cluster_id"], [F.desc("global_score"), F.asc("article_id")], listed, "pos")
        best = top.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "article_id"))), lambda x: x["article_id"]).alias("articles"))
        rows = rows.join(best, "cluster_id", "left")
    else:
        rows = rows.withColumn("articles", F.lit(None).cast("array<bigint>"))
    return rows.select(
        "graph_id", "cluster_id", "coverage_count", "sources_count", "max_score", F.round("age_hours", 6).alias("age_hours"),
        "dominant_topic", "dominant_event_type", "pulsing",
        F.array_join("entities", "|").alias("entities"), F.round("importance", 6).alias("importance"),
        F.round(F.coalesce("x", F.lit(0.5)), 4).alias("x"), F.round(F.coalesce("y", F.lit(0.5)), 4).alias("y"),
        F.coalesce("edges", F.lit(0)).alias("edges"), "best_edge", "links", "articles", "set_key",
    )
