"""Query of the token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm.records import articles, read
from rankmill.llm.token_files import token_index, write_token_files


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(articles(read(spark, sf_dir, "documents")), tokenizer_file())
    return token_index(files).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
