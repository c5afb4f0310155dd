"""Query of the byte-pair encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm.byte_pairs import decode_articles, encode_articles
from rankmill.llm.records import articles, read


def word_tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = word_tokenizer_file()
    found = decode_articles(encode_articles(articles(read(spark, sf_dir, "documents")), file), file)
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
