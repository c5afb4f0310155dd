"""Query of the main texts of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm.page_text import extract_main_text
from rankmill.llm.records import read
from rankmill.llm.url_lists import url_host


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return extract_main_text(pages.select(url_host(F.col("url")).alias("list_key"), "page_id", "url", "html"))
