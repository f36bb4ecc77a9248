"""A corpus pipeline of the operators: each stage works on all that the one before it kept.

Every stage takes documents as they come: extra columns, also under the operators' own names, pass unchanged; rows that
repeat are judged alike; texts are read whole, whatever their length; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgraph.llm import decontaminate, language, pieces, queries, simhash, toxicity
from newsgraph.llm.common import read
from newsgraph.session import shared_folder


#: A document in which no language holds this share has no language; text that mixes two keeps the larger one.
LANGUAGE_SHARE = 1 / 3


def toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of a toxicity score below the threshold; null and empty texts score 0 and stay, a tie with it goes."""
    names = docs.columns
    model = toxicity.learn(docs, read(spark, folder, "labels"), toxicity.trainable())
    # the model's columns replace columns of these names, which therefore wait under others
    rows = docs.withColumnsRenamed({c: f"__doc_{c}" for c in names})
    kept = toxicity.score(rows, model, rows.columns, "__doc_text").filter(F.col("score") < toxicity.THRESHOLD)
    return kept.select(*(F.col(f"__doc_{c}").alias(c) for c in names))


def languages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a language: texts that are null or without a letter go, and those in which no language holds a third."""
    names = docs.columns
    field = language.learn(docs, language.trainable())
    rows = docs.withColumnsRenamed({c: f"__doc_{c}" for c in names})
    kept = language.predict(rows, field, rows.columns, "__doc_text").filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LANGUAGE_SHARE))
    return kept.select(*(F.col(f"__doc_{c}").alias(c) for c in names))


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: that of smallest id; all rows of a kept id, and of a group without ids one row."""
    return simhash.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a benchmark passage; null and empty texts have none, and passages without an item id count too."""
    return decontaminate.decontaminate(docs, read(spark, folder, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Ids and source spans of the pieces of each document, a row a row; null and empty texts have no pieces."""
    return pieces.encode(docs, queries.model_path(), ["doc_id", "lang", "source"])


STAGES = [("toxicity", toxic), ("language", languages), ("near_copies", near_copies), ("benchmark", benchmark), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder and read again."""
    import uuid

    docs = read(spark, folder, "documents")
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, folder)
