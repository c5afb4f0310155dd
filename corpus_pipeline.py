"""The corpus pipeline: from documents to token files.

Each stage gets what the one before it kept, written as Parquet and read again,
and calls one operator of rankmill.llm on all of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm.decontamination import clean_articles
from rankmill.llm.jaccard_join import one_per_group
from rankmill.llm.language import known_articles, learn_languages
from rankmill.llm.mixing import mixed_rows
from rankmill.llm.records import articles, read
from rankmill.llm.token_files import token_index, write_token_files
from rankmill.llm.token_queries import tokenizer_file
from rankmill.session import work_path


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without a letter go."""
    model = learn_languages(docs.select(F.col("text").alias("content"), "lang"))
    return known_articles(docs, "text", model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles link at a similarity of 0.8 or more."""
    return one_per_group(docs, "doc_id", "text")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are in windows of benchmark items, long spans cut out of them."""
    return clean_articles(docs, "text", read(spark, sf_dir, "benchmark"), n_chars="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole."""
    return mixed_rows(docs, "doc_id", "text", "source")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what is read back from them."""
    found = token_index(write_token_files(articles(docs), tokenizer_file()))
    return found.withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", languages),
    ("near_copies", near_copies),
    ("benchmark", benchmark_passages),
    ("mixture", mixture),
    ("token_files", token_files),
]

#: languages are learned and tokens need the tokenizer, so SQL can't express the rows
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
