"""Release patterns are searched once a row, however many parts of the assessment use them."""

from pyspark.sql import functions as F

from newsgraph import constants as K
from newsgraph.functions import features as FT


def test_a_pattern_is_searched_once(spark):
    rows = spark.createDataFrame([("t", "x", "https://a.example", "s")], "title string, text string, url string, source string")
    found = rows.select(FT.release_assessment(F.col("title"), F.col("text"), F.col("url"), F.col("source")).alias("r")).select("r.is_release", "r.evidence")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(K.RELEASE_FRAMING[0]) == 1
