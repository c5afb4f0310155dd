"""Aggregates. Everything is pre-aggregated before the shuffle; no group is collected whole."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill import fixed_values as fv
from rankmill import functions as fn
from rankmill.schemas import CHARACTER_KEY


def population_cube(rows: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Counts by (), class, server and (server, class) in one scan, `all` marking the roll-up.

    Rows are counted per (server, class) first and the few counts are cubed, so
    the grouping sets do not multiply the scanned rows. `grouping()` and not a
    null test tells a roll-up from a missing class. Every rank type counts.
    """
    base = rows.groupBy(*extra_keys, "server_name", "class_name").agg(F.count(F.lit(1)).alias("n"))
    return cube_counts(base, extra_keys)


def cube_counts(base: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """The cube over pre-aggregated counts `n`. Without rows the grand total is 0 and stands alone."""
    pair = ["server_name", "class_name"]
    counts = base.select(*extra_keys, *pair, "n")
    if not extra_keys:
        # a row that counts nothing keeps the grand total alive on empty input
        nobody = base.sparkSession.range(1).select(
            *[F.lit(None).cast(base.schema[c].dataType).alias(c) for c in pair], F.lit(0).cast("bigint").alias("n")
        )
        counts = counts.unionByName(nobody)
    sets = [[*extra_keys, *chosen] for chosen in ([], ["class_name"], ["server_name"], pair)]
    cubed = counts.groupingSets(
        [[F.col(c) for c in chosen] for chosen in sets], *[F.col(c) for c in [*extra_keys, *pair]]
    ).agg(
        F.sum("n").alias("population"),
        F.grouping("server_name").alias("_all_servers"),
        F.grouping("class_name").alias("_all_classes"),
    )
    every_server, every_class = F.col("_all_servers") == 1, F.col("_all_classes") == 1
    return cubed.filter((F.col("population") > 0) | (every_server & every_class)).select(
        *extra_keys,
        F.when(every_server, fv.ALL_LABEL).otherwise(F.col("server_name")).alias("server_name"),
        F.when(every_class, fv.ALL_LABEL).otherwise(F.col("class_name")).alias("class_name"),
        "population",
        F.lit(1).alias("div"),
    )


def queue_stats(requests: DataFrame, as_of: datetime | Column, hours: int = 24) -> DataFrame:
    """Requests of the last hours by status, 0 for a status that does not occur."""
    recent = requests.filter(F.col("created_at") > fn.moment(as_of) - fn.seconds(hours * 3600))
    counts = recent.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    states = requests.sparkSession.createDataFrame([(s,) for s in fv.STATUSES], "status string")
    return states.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("requests"))


def stale_frontier(ranking: DataFrame, as_of: datetime | Column, div: int = 1) -> DataFrame:
    """Names of a rank type whose newest row is older than today, or has no time at all."""
    latest = (
        ranking.filter(F.col("div") == div)
        .groupBy("server_name", "character_name")
        .agg(F.max("retrieved_at").alias("latest_retrieved_at"))
    )
    old = F.col("latest_retrieved_at") < fn.day_start(as_of)
    return latest.filter(old | F.col("latest_retrieved_at").isNull())


def recent_count(ranking: DataFrame, as_of: datetime | Column, seconds: int = 3600) -> DataFrame:
    recent = ranking.filter(F.col("retrieved_at") >= fn.moment(as_of) - fn.seconds(seconds))
    return recent.agg(F.count(F.lit(1)).alias("rows"))


def total_population(populations: DataFrame) -> DataFrame:
    return populations.agg(F.coalesce(F.sum("population"), F.lit(0)).cast("bigint").alias("population"))


def choose_total(from_servers: Column, stored: Column, from_classes: Column) -> Column:
    """Sum over servers if positive, else the stored total if positive, else the sum over classes."""
    return F.coalesce(fn.positive_or_null(from_servers), fn.positive_or_null(stored), from_classes)


def class_share(classes: DataFrame, total: Column) -> DataFrame:
    """Share of each class and its head count rescaled to `total` (a value or a scalar subquery)."""
    class_sum = classes.agg(F.sum("population")).scalar()
    # the totals become columns once; the exact division below names them several times
    placed = classes.select("class_name", "population", class_sum.alias("_sum"), total.alias("_total"))
    people, part_sum = F.col("population"), F.col("_sum")
    return placed.select(
        "class_name",
        fn.rescale_half_even(people, part_sum, F.col("_total")).alias("population"),
        fn.percent_half_even(people, part_sum).alias("percentage"),
        F.col("_total").alias("total_population"),
    )


def crawl_totals(activity: DataFrame) -> DataFrame:
    """Collected, flushed and still pending rows per server with a grand total."""
    totals = (
        activity.groupBy("server_name")
        .agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("outcome") != "pending").alias("f"))
        .rollup("server_name")
        .agg(F.sum("c").alias("collected"), F.sum("f").alias("flushed"), F.grouping("server_name").alias("_g"))
    )
    return totals.filter(F.col("collected").isNotNull()).select(
        F.when(F.col("_g") == 1, fv.ALL_LABEL).otherwise(F.col("server_name")).alias("server_name"),
        "collected",
        "flushed",
        (F.col("collected") - F.col("flushed")).alias("pending"),
    )


def throughput(activity: DataFrame) -> DataFrame:
    """Rows per second, mean batch duration and the time the rest will take; 0 when no time passed."""
    batches = activity.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("outcome") == "pending").alias("open"),
        F.min("logged_at").alias("t0"),
        F.max("logged_at").alias("t1"),
    )
    spent = fn.age_seconds(F.col("t1"), F.col("t0"))
    total = batches.agg(
        F.sum("items").alias("items"),
        F.sum("open").alias("remaining"),
        F.count(F.lit(1)).alias("batches"),
        F.sum(spent).alias("batch_seconds"),
        fn.age_seconds(F.max("t1"), F.min("t0")).alias("elapsed_seconds"),
    )
    rate = F.when(F.col("elapsed_seconds") > 0, F.col("items") / F.col("elapsed_seconds")).otherwise(F.lit(0.0))
    return total.select(
        "items",
        "remaining",
        "batches",
        "elapsed_seconds",
        rate.alias("items_per_second"),
        F.try_divide("batch_seconds", "batches").alias("mean_batch_seconds"),
        F.when(F.col("elapsed_seconds") > 0, F.col("remaining") / (F.col("items") / F.col("elapsed_seconds")))
        .otherwise(F.lit(0.0))
        .alias("remaining_seconds"),
    )


def complete_types(rows: DataFrame) -> DataFrame:
    """Per character: all rank types present, none present."""
    known = F.when(F.col("div").isin(*fv.RANK_TYPES), F.col("div"))
    return (
        rows.groupBy(*CHARACTER_KEY)
        .agg(*[F.count_if(known == div).alias(f"_{div}") for div in fv.RANK_TYPES])
        .select(
            *CHARACTER_KEY,
            sum((F.col(f"_{d}") > 0).cast("int") for d in fv.RANK_TYPES).alias("types"),
        )
        .select(
            *CHARACTER_KEY,
            (F.col("types") == len(fv.RANK_TYPES)).alias("all_present"),
            (F.col("types") == 0).alias("none_present"),
        )
    )


def pivot_rank_types(ranking: DataFrame, values: Sequence[str] = ("rank_position", "power_value")) -> DataFrame:
    """The rank types of a character side by side; a missing type is null."""
    aggregates = [F.max(v).alias(v) for v in values]
    wide = ranking.groupBy(*CHARACTER_KEY).pivot("div", list(fv.RANK_TYPES)).agg(*aggregates)
    renamed = [F.col(f"{d}_{v}" if len(values) > 1 else str(d)).alias(f"{v}_{d}") for d in fv.RANK_TYPES for v in values]
    return wide.select(*CHARACTER_KEY, *renamed)


def rank_type_document(ranking: DataFrame) -> DataFrame:
    """Nested form: rank type name -> list of rows, an empty list where the type is missing."""
    row = F.struct("rank_position", "change_amount", "change_type", "class_name", "power_value", "retrieved_at")
    per_type = [F.max(F.when(F.col("div") == d, row)).alias(f"_{d}") for d in fv.RANK_TYPES]
    wide = ranking.groupBy(*CHARACTER_KEY).agg(*per_type)
    entries = []
    for d in fv.RANK_TYPES:
        entries += [F.lit(fv.RANK_TYPE_NAMES[d]), F.array_compact(F.array(f"_{d}"))]
    return wide.select(*CHARACTER_KEY, F.create_map(*entries).alias("rankings"))


def worker_totals(activity: DataFrame) -> DataFrame:
    """Processed and failed per worker, with the sum over workers under `all`."""
    totals = (
        activity.groupBy("worker_id")
        .agg(F.count_if(F.col("outcome") == "saved").alias("p"), F.count_if(F.col("outcome") == "failed").alias("f"))
        .rollup("worker_id")
        .agg(F.sum("p").alias("processed"), F.sum("f").alias("failed"), F.grouping("worker_id").alias("_g"))
    )
    return totals.filter(F.col("processed").isNotNull()).select(
        F.when(F.col("_g") == 1, fv.ALL_LABEL).otherwise(F.col("worker_id")).alias("worker_id"), "processed", "failed"
    )


def log_level_counts(lines: DataFrame) -> DataFrame:
    return lines.agg(
        F.count_if(F.contains("line", F.lit("ERROR"))).alias("errors"),
        F.count_if(F.contains("line", F.lit("WARNING"))).alias("warnings"),
    )


def page_yield(rows: DataFrame, first: DataFrame) -> DataFrame:
    """Per page: rows found and rows seen there for the first time."""
    new = first.groupBy("page_seq").agg(F.count(F.lit(1)).alias("new_rows"))
    found = rows.groupBy("page_seq").agg(F.count(F.lit(1)).alias("rows_found"))
    return found.join(new, "page_seq", "left").select(
        "page_seq", "rows_found", F.coalesce("new_rows", F.lit(0)).alias("new_rows")
    )


def batch_success_rate(activity: DataFrame) -> DataFrame:
    """Saved rows in percent of attempted ones per batch; 0 for a batch without attempts."""
    counts = activity.groupBy("batch_id").agg(
        F.count_if(F.col("outcome") != "pending").alias("attempted"),
        F.count_if(F.col("outcome") == "saved").alias("succeeded"),
    )
    rate = F.when(F.col("attempted") > 0, fn.percent_half_even(F.col("succeeded"), F.col("attempted")))
    return counts.select("batch_id", "attempted", "succeeded", F.coalesce(rate, F.lit(0.0)).alias("success_rate"))


def timeout_alert(timed_out: DataFrame, shown: int = 5, many: int = 3) -> DataFrame:
    """How many requests timed out, the first ids, and how bad it is."""
    first = timed_out.select("request_id").orderBy("request_id").limit(shown)
    ids = first.agg(F.concat_ws(", ", F.array_sort(F.collect_list("request_id"))).alias("ids"))
    count = timed_out.agg(F.count(F.lit(1)).alias("timed_out"))
    listed = ids.scalar()
    return count.select(
        "timed_out",
        F.concat(listed, F.when(F.col("timed_out") > shown, "...").otherwise("")).alias("ids"),
        F.when(F.col("timed_out") > many, "error")
        .when(F.col("timed_out") > 0, "warning")
        .otherwise("none")
        .alias("severity"),
    )


def axis_limit(populations: DataFrame) -> DataFrame:
    return populations.agg((F.max("population") * F.lit(1.2)).alias("axis_limit"))
