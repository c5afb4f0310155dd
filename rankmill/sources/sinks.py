"""Writes. State is merged by bucket; appends belong to a run and replace what an earlier try of it has written."""

from __future__ import annotations

from datetime import datetime
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.functions import moment
from rankmill.operators.mutations import by_all_columns
from rankmill.operators.windows import first_per_key
from rankmill.schemas import RANKING_KEY, SNAPSHOT_KEY, STAGING
from rankmill.session import settle
from rankmill.sources.keyed_state import BUCKETS, merge_state, path_exists, read_state


def sink_upsert_ranking(
    changes: DataFrame, root: str, *, schema, order_by, event_time: str | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Merges changes into the stored state, rewriting the buckets they touch, and returns the state."""
    merge_state(
        changes, root, schema=schema, keys=RANKING_KEY, order_by=order_by, event_time=event_time, buckets=buckets
    )
    return read_state(changes.sparkSession, root, schema)


def sink_snapshot(snapshot: DataFrame, path: str, retrieved_at: datetime | Column | None = None) -> None:
    """Appends a snapshot; rows whose key is already stored are left out, so the first run of a day wins.

    Of several new rows of one key the first by all columns is kept. Of what is
    stored only the folders between the first and the last new date are read.
    With `retrieved_at` the rows carry the time of this run.
    """
    spark = snapshot.sparkSession
    if retrieved_at is not None:
        snapshot = snapshot.withColumn("retrieved_at", moment(retrieved_at))
    new = settle(first_per_key(snapshot, SNAPSHOT_KEY, by_all_columns(snapshot, SNAPSHOT_KEY)))
    if path_exists(spark, path):
        schema = ", ".join(f"`{name}` {kind}" for name, kind in snapshot.dtypes)
        first, last = new.agg(F.min("date"), F.max("date")).first()
        stored = spark.read.schema(schema).parquet(path).filter(F.col("date").between(first, last)).select(*SNAPSHOT_KEY)
        new = new.join(stored, SNAPSHOT_KEY, "left_anti").select(snapshot.columns)
    new.repartition("date").write.partitionBy("date").mode("append").parquet(path)


def article_rows(articles: DataFrame, scraped_at: datetime | Column) -> DataFrame:
    """Article record with the whole record as JSON text."""
    record = F.to_json(F.struct(*articles.columns))
    return articles.select("id", "title", "post_date", record.alias("contents_json"), moment(scraped_at).alias("scraped_at"))


def append_run(rows: DataFrame, path: str, run: str) -> None:
    """Adds the rows of one run to a table partitioned by `run`. A run that is repeated replaces its own rows, those of others stay.

    A run without rows leaves none of an earlier try.
    """
    folder = f"{path}/run={quote(run, safe='-.')}"
    rows.write.mode("overwrite").parquet(folder)


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that all runs have appended, with their `run`."""
    return spark.read.schema(f"{schema}, run string").parquet(path)


def sink_articles_json(articles: DataFrame, path: str, scraped_at: datetime | Column, run: str) -> None:
    """Appends the article records of one run; the same run again writes them once."""
    append_run(article_rows(articles, scraped_at), path, run)


def audit_rows(deleted: DataFrame, created_at: datetime | Column) -> DataFrame:
    """One history row per deleted name: how many rows went and the name as a list."""
    at = moment(created_at)
    return deleted.select(
        F.lit("DELETE").alias("operation_type"),
        F.lit("ranking").alias("object_type"),
        F.col("server_name").alias("object_id"),
        F.concat(F.lit("deleted "), F.date_format(at, "yyyy-MM-dd HH:mm:ss")).alias("details"),
        F.col("count").cast("int").alias("count"),
        F.array("character_name").alias("character_list"),
        at.alias("created_at"),
    )


def sink_audit(deleted: DataFrame, path: str, created_at: datetime | Column, run: str) -> None:
    """Appends the history rows of one run; the same run again writes them once."""
    append_run(audit_rows(deleted, created_at), path, run)


def sink_staging_tsv(rows: DataFrame, path: str) -> None:
    columns = [c for c in STAGING.fieldNames() if c != "corrupt_record"]
    writer = rows.select(*columns).write.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
    writer.csv(path, sep="\t")


def sink_log(lines: DataFrame, path: str) -> None:
    """Log files in line order: ranges of line numbers, one per file."""
    lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("line").write.text(path)
