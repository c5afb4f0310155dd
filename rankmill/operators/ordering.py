"""Orders and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill import fixed_values as fv
from rankmill.operators.windows import first_per_key


def frontier_order() -> list[Column]:
    """Never updated first, then the oldest, then by name."""
    return [F.asc_nulls_first("latest_retrieved_at"), F.asc("character_name")]


def order_frontier(frontier: DataFrame) -> DataFrame:
    return frontier.orderBy(*frontier_order())


REQUEST_ORDER = ("priority", "created_at", "request_id")


def next_request(requests: DataFrame, n: int = 1) -> DataFrame:
    """The pending requests to take next: lowest priority number, then the oldest."""
    return requests.filter(F.col("status") == "pending").orderBy(*REQUEST_ORDER).limit(n)


def next_per_server(requests: DataFrame) -> DataFrame:
    """The same choice for every server at once."""
    pending = requests.filter(F.col("status") == "pending")
    return first_per_key(pending, ["server"], [F.asc(c) for c in REQUEST_ORDER])


def classes_by_population(classes: DataFrame) -> DataFrame:
    return classes.orderBy(F.desc("population"), F.asc("class_name"))


def by_server_name(rows: DataFrame) -> DataFrame:
    return rows.orderBy("server_name")


def last_errors(lines: DataFrame, n: int = 5) -> DataFrame:
    return lines.filter(F.contains("line", F.lit("ERROR"))).orderBy(F.desc("line_no")).limit(n)


def names_or_default(names: DataFrame, servers: DataFrame, default: str = fv.DEFAULT_FRONTIER_NAME) -> DataFrame:
    """Names in rank order per server; a server without names gets the default name."""
    missing = servers.select("server_name").distinct().join(
        names.select("server_name").distinct(), "server_name", "left_anti"
    )
    filler = missing.select(
        "server_name", F.lit(default).alias("character_name"), F.lit(None).cast("int").alias("rank_position")
    )
    return names.select("server_name", "character_name", "rank_position").unionByName(filler)


def latest_artifact(files: DataFrame, prefix: str) -> DataFrame:
    """Greatest name with the prefix; the date inside the name makes it the newest."""
    return files.filter(F.startswith("name", F.lit(prefix))).agg(F.max("name").alias("name"))


def top_n_classes(report: DataFrame, n: int = 5) -> DataFrame:
    return report.orderBy(F.desc("population"), F.asc("class_name")).limit(n)
