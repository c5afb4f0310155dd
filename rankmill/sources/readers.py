"""Scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.operators.windows import numbered
from rankmill.schemas import RANKING, STAGING


def scan_ranking(spark: SparkSession, path: str) -> DataFrame:
    """Current state from a parquet folder."""
    return spark.read.schema(RANKING).parquet(path)


def scan_ranking_jdbc(spark: SparkSession, url: str, table: str, *, column: str, low: str, high: str, parts: int, **options) -> DataFrame:
    """Current state from a database, read in `parts` ranges of `column`."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts, **options
    )
    return reader.load().select(RANKING.fieldNames())


def scan_staging_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab separated bulk load; a line that does not fit keeps its text in corrupt_record."""
    reader = spark.read.schema(STAGING).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
    return reader.csv(path, sep="\t", mode="PERMISSIVE", columnNameOfCorruptRecord="corrupt_record", enforceSchema=True)


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages: a parquet folder, or a folder of files with one page each."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema("page_id bigint, url string, html string").parquet(path)
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def scan_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with their number: files in name order, lines in file order."""
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("line"),
    )
    order = [F.asc("_file"), F.asc("_start"), F.asc("_at")]
    return numbered(text, order, name="line_no").select("line_no", "line")
