"""Query of the language labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm.language import label_articles, learn_languages
from rankmill.llm.records import articles, fold, read

HELD_OUT = 2


def training_articles(documents: DataFrame) -> DataFrame:
    return documents.where(fold("doc_id", 4) != HELD_OUT).select(F.col("text").alias("content"), "lang")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    labels = label_articles(articles(documents), learn_languages(training_articles(documents)))
    return labels.withColumnRenamed("id", "doc_id").select(
        "doc_id", (fold("doc_id", 4) == HELD_OUT).alias("held_out"), "lang_pred", "score"
    )
