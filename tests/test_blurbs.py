"""A blurb takes each text's white space out once."""

from pyspark.sql import functions as F

from newsgraph.functions import text as T


def test_a_text_is_collapsed_once(spark):
    rows = spark.createDataFrame([("Title", "Title: " + "word " * 80, "<<a|b>>"), ("T", None, "A snippet"), (None, "short", None)], "title string, text string, snippet string")
    found = rows.select(T.article_blurb(F.col("title"), F.lit(None).cast("string"), F.col("snippet"), F.col("text")).alias("b"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\s+") <= 5  # body, its title, snippet, summary, title
    assert [r.b for r in found.collect()] == [("word " * 80)[:239] + "...", "A snippet", ""]
