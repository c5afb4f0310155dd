"""The project's records that the operators work on, made from the given tables.

An article is `id`, `content` and the list it was found in (`list_key`), as
extract_article and list_pages name them. A log line is `line_no` and `line`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("list_key")
    )


def log_lines(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("line_no"), F.col("text").alias("line"))


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds
