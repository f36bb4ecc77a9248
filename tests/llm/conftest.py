import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with extra columns under the operators' own names."""

    def make(rows, clash=()):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, COLUMNS)
        for name in clash:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("old"))
        return df

    return make
