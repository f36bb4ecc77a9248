"""Evaluation samples and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgraph.functions import maps
from newsgraph.operators.ranking import top_per_group

c = F.col
r = maps.round_half_even


def shuffle_key(key: str, seed: str) -> Column:
    """A fixed random order: hash of the key and a seed."""
    return F.md5(F.concat_ws(":", c(key).cast("string"), F.lit(seed)))


def stratified(rows: DataFrame, key: str, stratum: str, rest: str, target: int, seed: str) -> DataFrame:
    """A few rows per stratum, the remainder from the catch-all stratum, ``target`` in all."""
    strata = rows.filter(c(stratum) != rest).agg(F.count_distinct(stratum).alias("_strata"))
    ranked = top_per_group(rows.withColumn("_k", shuffle_key(key, seed)), [stratum], [F.asc("_k"), F.asc(key)], target, "_rn")
    # At most ``target`` rows per stratum from here on.
    ranked = ranked.crossJoin(F.broadcast(strata)).withColumn("_each", F.when(c("_strata") > 0, F.greatest(F.lit(2), F.floor(F.lit(target) / (c("_strata") + 1)))).otherwise(target))
    named = ranked.filter((c(stratum) != rest) & (c("_rn") <= c("_each")))
    taken = named.agg(F.count("*").alias("_taken"))
    other = ranked.filter(c(stratum) == rest).crossJoin(F.broadcast(taken)).filter(c("_rn") <= F.greatest(F.lit(0), target - c("_taken"))).drop("_taken")
    return named.unionByName(other).orderBy("_k", key).limit(target).drop("_rn", "_k", "_strata", "_each")


def banded(rows: DataFrame, key: str, score: str, bands: list[tuple[float, float, int]], seed: str) -> DataFrame:
    """Rows per score band: (low, high, how many)."""
    band = F.lit(None).cast("int")
    quota = F.lit(0)
    for n, (low, high, size) in enumerate(bands):
        inside = (c(score) >= low) & (c(score) < high)
        band = F.when(inside, n).otherwise(band)
        quota = F.when(c("band") == n, size).otherwise(quota)
    ranked = rows.withColumn("band", band).filter("band is not null").withColumn("_k", shuffle_key(key, seed))
    kept = top_per_group(ranked, ["band"], [F.asc("_k"), F.asc(key)], max(b[2] for b in bands), "_rn")
    return kept.filter(c("_rn") <= quota).drop("_rn", "_k")


def summary_samples(rows: DataFrame, key: str, seed: str, size: int = 20, shown: int | None = 2000) -> DataFrame:
    """Rows with a summary of over 30 and a text of over 500 characters, by hash order; ``shown`` characters of each text."""
    fit = rows.filter((F.length("summary") > 30) & (F.length("text") > 500))
    drawn = fit.withColumn("_k", shuffle_key(key, seed)).orderBy("_k", key).limit(size)
    return drawn.select(key, (c("text") if shown is None else F.substring("text", 1, shown)).alias("text"), "summary")


def recent_clusters(stats: DataFrame, limit: int = 100, coverage: int = 2, least: int = 4) -> DataFrame:
    """Newest clusters of ``coverage`` articles, or of any number if fewer than ``least`` have as many."""
    wide = stats.agg(F.count_if(c("coverage_count") >= coverage).alias("_wide"))
    fit = stats.crossJoin(F.broadcast(wide)).filter((c("coverage_count") >= coverage) | (c("_wide") < least)).drop("_wide")
    return fit.orderBy(F.desc("last_seen"), F.asc("cluster_id")).limit(limit)


def pair_samples(clusters: DataFrame, seed: str, size: int = 10) -> DataFrame:
    """``size`` pairs: of those that share an entity and one pair per event type, filled up with random pairs.

    ``clusters`` is the bounded sample of clusters: (cluster_id, entities, event_type).  Pairs with a shared entity are
    expected to be related, pairs of one type may be, random ones are not.  Choices are by hash order.
    """
    key = F.md5(F.concat_ws(":", c("a").cast("string"), c("b").cast("string"), F.lit(seed)))
    e = clusters.select("cluster_id", F.explode("entities").alias("entity")).withColumn("entity", F.lower("entity"))
    shared = (
        e.alias("a").join(e.alias("b"), (c("a.entity") == c("b.entity")) & (c("a.cluster_id") < c("b.cluster_id")))
        .groupBy(c("a.cluster_id").alias("a"), c("b.cluster_id").alias("b")).agg(F.min("a.entity").alias("why")).withColumn("related", F.lit(True))
    )
    two = top_per_group(
        clusters.filter(c("event_type") != "OTHER").withColumn("_k", shuffle_key("cluster_id", seed)), ["event_type"], [F.asc("_k"), F.asc("cluster_id")], 2
    )
    typed = two.groupBy("event_type").agg(F.min("cluster_id").alias("a"), F.max("cluster_id").alias("b")).filter("a < b")
    typed = typed.select("a", "b", c("event_type").alias("why"), F.lit(None).cast("boolean").alias("related")).join(shared.select("a", "b"), ["a", "b"], "left_anti")
    known = shared.unionByName(typed.select("a", "b", "why", "related"))
    ids = clusters.select("cluster_id", F.lit(0).alias("_all"))
    loose = ids.select(c("cluster_id").alias("a"), "_all").join(ids.select(c("cluster_id").alias("b"), "_all"), "_all").filter("a < b")
    loose = loose.join(known, ["a", "b"], "left_anti").select("a", "b", F.lit("random").alias("why"), F.lit(False).alias("related"))
    rows = known.withColumn("_class", F.lit(0)).unionByName(loose.withColumn("_class", F.lit(1)))
    return rows.withColumn("_k", key).orderBy("_class", "_k").limit(size).select("a", "b", "why", "related")


def summarize(results: DataFrame, groups: list[str]) -> DataFrame:
    """Mean per dimension, mean of those means, samples and failures.  (groups, dimension, mean, overall, …)."""
    counts = results.groupBy(*groups).agg(F.count("*").alias("samples"), F.count_if(F.size("errors") > 0).alias("failures"))
    means = results.select(*groups, F.explode("scores").alias("dimension", "s")).groupBy(*groups, "dimension").agg(r(F.avg("s"), 2).alias("mean"))
    overall = means.groupBy(*groups).agg(r(F.avg("mean"), 2).alias("overall"))
    return means.join(overall, groups).join(counts, groups)


def worst(results: DataFrame, groups: list[str], key: str, k: int = 3) -> DataFrame:
    values = F.map_values("scores")
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(values), F.lit(1))
    return top_per_group(results.withColumn("mean", F.round(mean, 6)), groups, [F.asc("mean"), F.asc(key)], k, "pos")


def compare(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Change per dimension; a missing side counts as 0."""
    a = first.select(*keys, c("mean").alias("before"))
    b = second.select(*keys, c("mean").alias("after"))
    zero = lambda n: F.coalesce(n, F.lit(0.0))
    return a.join(b, keys, "full_outer").select(
        *keys, zero("before").alias("before"), zero("after").alias("after"), F.round(zero("after") - zero("before"), 6).alias("delta")
    )


def blend_changes(rows: DataFrame, key: str) -> DataFrame:
    """Old upward-only blend against the two-way blend: rows whose score changes."""
    g, v = c("global_score"), c("verdict")
    mixed = 0.70 * g + 0.30 * v
    old = F.greatest(g, mixed)
    drop = g - mixed
    drop = F.when(c("confirmation") == "official", F.least(drop, F.lit(5.0))).otherwise(drop)
    drop = F.when(c("trust_label").isin("official", "confirmed", "likely"), drop * 0.5).otherwise(drop)
    new = F.when(mixed >= g, r(mixed, 2)).otherwise(r(g - F.least(drop, F.lit(15.0)), 2))
    staged = rows.select(key, old.alias("old"), new.alias("new")).withColumn("_d", c("new") - c("old"))
    return staged.filter(F.abs("_d") > 0.01).select(key, r(c("old"), 2).alias("old"), "new", r(c("_d"), 2).alias("delta"))


def blend_report(changes: DataFrame) -> DataFrame:
    return changes.agg(
        F.count("*").alias("changed"), F.count_if(F.abs("delta") > 5).alias("large"), F.min("delta").alias("lowest"),
        F.max("delta").alias("highest"), F.round(F.avg("delta"), 4).alias("mean"),
    )
