"""Query of the secret scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm.records import log_lines, read
from rankmill.llm.secrets import joined, secret_spans


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(log_lines(read(spark, sf_dir, "documents")))
    spans = F.col("spans")

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"] != "entropy")
    return found.select(
        F.col("line_no").alias("doc_id"),
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )
