"""Query of the language-model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm.language_model import learn, score_articles
from rankmill.llm.records import articles, fold, read

HELD_OUT = 2


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    training = documents.where(fold("doc_id", 7) != HELD_OUT)
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).bitwiseAND(0xFFFF)
    model, counts = learn(training.select(F.col("text").alias("content"), F.shiftright(part, 4).alias("part")))
    return score_articles(articles(documents), model, counts).select(
        F.col("id").alias("doc_id"),
        (fold("id", 7) == HELD_OUT).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.n_tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
