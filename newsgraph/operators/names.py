"""Average linkage of short texts by sparse word vectors, over an inverted index instead of dense vectors.

A cluster is its mean vector, a map of bucket to weight, and its size; the mean cosine of two clusters is the product of
their means, which are no longer than one.  Two clusters whose product reaches ``t`` share a set of buckets that holds at
least ``t``² of the squared length of either.  So they share

- one bucket that weighs ``t`` or more in both, or
- two buckets or more; what they share without its first bucket, in any order of all buckets, weighs at least ``t``²
  less the heaviest square of either, so that its first two lie where at least that much is still to come.

Each cluster is listed under its single heavy bucket and under the pairs of those leading buckets, rare ones first.  Lists
are joined, and the exact product decides.  A name of two or three words is in one list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsgraph.functions import features as FT
from newsgraph.operators.ranking import first_per_key
from newsgraph.session import cut_lineage

SLACK = 1e-9


def unit_words(names: DataFrame, key: str, name: str) -> DataFrame:
    """(key, words): the sparse unit vector of each name as entries by bucket; names without a word have no row."""
    counted = names.select(key, FT.explode_once(FT.words(F.col(name))).alias("_w")).filter("_w is not null")
    counts = counted.select(key, FT.word_bucket(F.col("_w")).alias("bucket")).groupBy(key, "bucket").agg(F.count("*").cast("double").alias("n"))
    rows = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("_e"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("_len"))
    return rows.select(key, F.transform("_e", lambda e: F.struct(e["bucket"].alias("bucket"), (e["n"] / F.col("_len")).alias("w"))).alias("words"))


def list_keys(entries: Column, at_least: float) -> Column:
    """Lists of a cluster, as text; ``entries`` are (order, w, bucket), rare buckets first."""
    bound = at_least * at_least - SLACK
    square = lambda e: e["w"] * e["w"]
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda a, e: a + square(e))
    heaviest = F.array_max(F.transform(entries, square))
    # squares from each entry on, by place: the whole less what lies before
    before = F.aggregate(entries, F.array(F.lit(0.0)), lambda held, e: F.concat(held, F.array(F.element_at(held, -1) + square(e))))
    leading = F.filter(F.zip_with(entries, before, lambda e, b: F.struct(e["bucket"].alias("bucket"), b.alias("b"))), lambda x: x["bucket"].isNotNull() & (total(entries) - x["b"] >= bound - heaviest - SLACK))
    names = F.transform(leading, lambda x: x["bucket"].cast("string"))
    pairs = F.flatten(F.transform(names, lambda x, i: F.transform(F.slice(names, i + 2, F.size(names)), lambda y: F.concat_ws("+", x, y))))
    single = F.transform(F.filter(entries, lambda e: e["w"] >= at_least - SLACK), lambda e: e["bucket"].cast("string"))
    return F.concat(single, pairs)


def product(a: Column, b: Column) -> Column:
    """Product of two maps, added by bucket, so that it is the same from either side."""
    return F.aggregate(
        F.array_sort(F.map_entries(a)), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))


def listed(clusters: DataFrame, places: DataFrame, at_least: float) -> DataFrame:
    """Clusters (c, m) under each of their lists: (list, c, m).  ``places`` gives each bucket its place (bucket, place)."""
    entries = clusters.select("c", F.explode("m").alias("bucket", "w")).join(F.broadcast(places), "bucket")
    ordered = entries.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("place", "w", "bucket"))).alias("_e"))
    keys = ordered.select("c", FT.explode_once(list_keys(F.col("_e"), at_least)).alias("list")).filter("list is not null")
    return keys.join(clusters.select("c", "m"), "c")


def partners(clusters: DataFrame, places: DataFrame, at_least: float) -> DataFrame:
    """Pairs of clusters that share a list, with their product: (c, other, product), each pair from both sides."""
    rows = cut_lineage(listed(clusters, places, at_least))
    left, right = rows.alias("x"), rows.alias("y")
    met = left.join(right, (F.col("x.list") == F.col("y.list")) & (F.col("x.c") < F.col("y.c")))
    scored = met.select(F.col("x.c").alias("a"), F.col("y.c").alias("b"), F.round(product(F.col("x.m"), F.col("y.m")), 9).alias("product"))
    near = scored.filter(F.col("product") >= at_least - SLACK)
    return near.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("other")), F.struct(F.col("b").alias("c"), F.col("a").alias("other")))).alias("p"), "product").select("p.*", "product")


def bucket_places(points: DataFrame, words: str) -> DataFrame:
    """(bucket, place): buckets by how many rows hold them, rare ones first.  At most ``features.DIMENSIONS`` rows."""
    from pyspark.sql import Window

    counts = points.select(F.explode(F.transform(words, lambda e: e["bucket"])).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("_n"))
    return counts.select("bucket", F.row_number().over(Window.orderBy("_n", "bucket")).alias("place"))


def sparse_linkage(points: DataFrame, key: str, words: str, at_least: float) -> DataFrame:
    """(key, cluster): average linkage on the cosine of sparse unit vectors, merging while the mean similarity of two
    clusters is at least ``at_least`` (over 0).  ``words`` is an array of (bucket, w) by bucket.

    Average linkage is reducible, so clusters that are each other's nearest merge side by side.  Equal vectors merge first.
    """
    if at_least <= 0:
        raise ValueError("at_least must be over 0: clusters that share no word are not compared")
    rows = cut_lineage(points.select(F.col(key).alias("_k"), F.col(words).alias("_w")))
    # the largest group of equal vectors is one row after combining before the shuffle
    reps = cut_lineage(rows.groupBy("_w").agg(F.min("_k").alias("c"), F.count("*").cast("double").alias("n")))
    places = cut_lineage(bucket_places(reps, "_w"))
    owner = cut_lineage(rows.join(reps, "_w").select(F.col("_k").alias("member"), "c"))
    clusters = cut_lineage(reps.select("c", F.map_from_entries("_w").alias("m"), "n"))
    while True:
        found = partners(clusters, places, at_least).withColumn("_o", -F.col("product")).withColumn("_a", F.least("c", "other")).withColumn("_b", F.greatest("c", "other"))
        best = cut_lineage(first_per_key(found, ["c"], ["_o", "_a", "_b"]).select("c", "other"))
        x, y = best.alias("x"), best.alias("y")
        merges = cut_lineage(
            x.join(y, (F.col("x.c") == F.col("y.other")) & (F.col("x.other") == F.col("y.c"))).filter(F.col("x.c") < F.col("x.other"))
            .select(F.col("x.other").alias("_gone"), F.col("x.c").alias("_kept"))
        )
        if merges.isEmpty():
            return owner.select(F.col("member").alias(key), F.col("c").alias("cluster"))
        owner = cut_lineage(owner.join(merges, owner["c"] == merges["_gone"], "left").select("member", F.coalesce("_kept", "c").alias("c")))
        named = clusters.join(merges, clusters["c"] == merges["_gone"], "left").select(F.coalesce("_kept", "c").alias("c"), "m", "n", F.col("_gone").isNotNull().alias("_late"))
        # at most two rows share a name here
        merged = named.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("_late", "n", F.map_entries("m").alias("e")))).alias("p"))
        first, second = F.col("p")[0], F.try_element_at("p", F.lit(2))
        both = F.map_zip_with(
            F.map_from_entries(first["e"]), F.map_from_entries(second["e"]),
            lambda k, a, b: (F.coalesce(a, F.lit(0.0)) * first["n"] + F.coalesce(b, F.lit(0.0)) * second["n"]) / (first["n"] + second["n"]))
        clusters = cut_lineage(merged.select(
            "c", F.when(F.size("p") == 1, F.map_from_entries(first["e"])).otherwise(both).alias("m"), (first["n"] + F.coalesce(second["n"], F.lit(0.0))).alias("n")))
