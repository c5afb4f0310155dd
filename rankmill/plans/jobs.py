"""The composite jobs. Intermediate results that are read more than once are settled first."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill import fixed_values as fv
from rankmill import functions as fn
from rankmill.operators import aggregates, filters, joins, mutations, ordering, windows
from rankmill.schemas import CHARACTER_KEY, RANKING_KEY
from rankmill.session import settle
from rankmill.sources import pages as page_source
from rankmill.sources import sinks


def class_report(ranking: DataFrame) -> DataFrame:
    """Share of every class, rescaled to the trusted total, numbered and formatted.

    One scan: counts and bottom ranks per (server, class) come from the same
    aggregate; the cube, the totals and the shares are computed from its few rows.
    """
    base = settle(
        ranking.groupBy("server_name", "class_name").agg(
            F.count(F.lit(1)).alias("n"), F.max("rank_position").alias("bottom")
        )
    )
    snapshot = aggregates.cube_counts(base)
    per_server = base.groupBy("server_name").agg(F.max("bottom").alias("population"))
    is_grand = (F.col("server_name") == fv.ALL_LABEL) & (F.col("class_name") == fv.ALL_LABEL)
    totals = per_server.agg(F.sum("population").alias("from_servers")).select(
        aggregates.choose_total(
            F.col("from_servers"),
            snapshot.filter(is_grand).agg(F.max("population")).scalar(),
            base.agg(F.sum("n")).scalar(),
        )
    )
    shares = aggregates.class_share(filters.class_rows_only(snapshot), totals.scalar())
    return report_rows(shares)


def report_rows(shares: DataFrame) -> DataFrame:
    """Index, name, formatted head count and percentage, as the report page shows them."""
    numbered = windows.report_index(shares)
    return numbered.select(
        "idx",
        "class_name",
        "population",
        fn.thousands(F.col("population"), fv.PERSON_SUFFIX).alias("population_formatted"),
        "percentage",
        "total_population",
    )


def server_populations(ranking: DataFrame, scraped: DataFrame | None = None) -> DataFrame:
    """Population per server: the bottom rank, re-checked against fresh rows of the same character."""
    bottom = joins.bottom_per_server(ranking)
    if scraped is None:
        checked = bottom.select("server_name", "character_name", F.col("rank_position").alias("population"))
    else:
        checked = joins.population_by_recheck(bottom, scraped)
    return ordering.by_server_name(checked)


def refresh_plan(ranking: DataFrame, as_of: datetime | Column, batch_size: int = 200) -> DataFrame:
    """Names due for refresh per server, the stalest first, cut into batches."""
    due = filters.drop_placeholder_names(aggregates.stale_frontier(ranking, as_of), "character_name")
    return windows.assign_batches(due, ordering.frontier_order(), batch_size, ["server_name"])


def ingest_pages(
    pages: DataFrame, state: DataFrame, as_of: datetime | Column
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(new state, per-batch reconciliation, audit rows, quarantined rows) from saved list pages.

    pages: page_seq, div, search_server, search_name, page_time, html. Pages are
    handled in the order of page_seq: a not-found page removes what the state and
    the pages before it hold of its name, and nothing that a later page lists.
    """
    kind = filters.page_kind(F.col("html"))
    # the pages are read and parsed once; both branches go on from the parsed form
    parsed = settle(
        pages.withColumn("kind", kind).select(
            "page_seq",
            "div",
            "search_server",
            "search_name",
            "page_time",
            "kind",
            F.when(F.col("kind") == "rows", page_source.list_items(F.col("html"))).alias("items"),
        )
    )
    items = page_source.item_rows(parsed, ["page_seq", "div", "page_time"], F.col("items"))
    flagged = settle(filters.flag_valid_rows(items))
    quarantine = flagged.filter("NOT valid").drop("valid")
    batch = flagged.filter("valid").select(
        "page_seq",
        "pos",
        "rank_position",
        "change_amount",
        "change_type",
        "server_name",
        "character_name",
        "class_name",
        "power_value",
        "div",
        F.col("page_time").alias("retrieved_at"),
    )
    newest = [F.desc("retrieved_at"), F.desc("page_seq"), F.desc("pos")]
    names = [F.col("search_server").alias("server_name"), F.col("search_name").alias("character_name")]
    missing = parsed.filter("kind = 'not_found'").groupBy(*names).agg(F.max("page_seq").alias("_gone_at"))
    missing = settle(missing)
    dated = batch.join(missing, CHARACTER_KEY, "left")
    alive = F.col("_gone_at").isNull() | (F.col("page_seq") > F.col("_gone_at"))
    left, _ = mutations.delete_key(state, missing, CHARACTER_KEY)
    final = mutations.upsert_latest(left, dated.filter(alive).drop("_gone_at"), order_by=newest)

    held = state.select(*RANKING_KEY).join(missing, CHARACTER_KEY, "left_semi")  # few names, so the rest isn't made distinct
    gone = held.select(*RANKING_KEY).union(dated.filter(~alive).select(*RANKING_KEY)).distinct()
    audit = sinks.audit_rows(mutations.deleted_names(gone, missing), as_of)

    given = batch.select(*RANKING_KEY, F.col("page_seq").alias("batch_id"), F.col("retrieved_at").alias("batch_time"))
    saved = windows.first_per_key(batch, RANKING_KEY, newest)  # what the upsert puts under the batch's keys, before names are removed
    report = joins.reconcile_saved(given, saved)
    return final, report, audit, quarantine


ANSWER_FIELDS = ("rank", "power", "change", "change_type", "class", "retrieved_at")


def character_answer(
    ranking: DataFrame,
    fresh_source: DataFrame,
    as_of: datetime | Column,
    ttl: int = fv.FRESH_SECONDS,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Per character the rank types side by side: from fresh stored rows when all are there, else from the source.

    Every rank type has its own fields (`rank_1`, `class_2`, ...), null where it is
    missing. `asked` names (server_name, character_name) get an answer in any
    case: those neither source knows are not found.
    """
    stored = filters.fresh_rows(ranking, as_of, ttl)
    chosen = joins.prefer_source(stored, fresh_source.select(stored.columns))
    shaped = chosen.select(
        "server_name", "character_name", "div", "source",
        F.struct(
            fn.thousands(F.coalesce("rank_position", F.lit(0)), fv.RANK_SUFFIX).alias("rank"),
            fn.thousands(F.coalesce("power_value", F.lit(0))).alias("power"),
            F.coalesce("change_amount", F.lit(0)).alias("change"),
            F.coalesce("change_type", F.lit("none")).alias("change_type"),
            F.coalesce("class_name", F.lit("")).alias("class"),
            F.col("retrieved_at"),
        ).alias("row"),
    )
    per_type = [F.max(F.when(F.col("div") == d, F.col("row"))).alias(f"_{d}") for d in fv.RANK_TYPES]
    found = shaped.groupBy(*CHARACTER_KEY).agg(F.max("source").alias("source"), *per_type)
    if asked is not None:
        found = asked.select(*CHARACTER_KEY).distinct().join(found, CHARACTER_KEY, "left")
    parts = F.split(F.lit(fv.NAME_NOT_FOUND_MESSAGE), r"[{][a-z]+[}]")
    not_found = F.concat(parts[0], F.col("character_name"), parts[1], F.col("server_name"), parts[2])
    return found.select(
        *CHARACTER_KEY,
        "source",
        F.col("source").isNotNull().alias("success"),
        F.coalesce(F.col("source") == "primary", F.lit(False)).alias("from_cache"),
        F.when(F.col("source") == "primary", fv.CACHE_MESSAGE)
        .when(F.col("source").isNotNull(), fv.FOUND_MESSAGE)
        .otherwise(not_found)
        .alias("message"),
        *[F.col(f"_{d}.{c}").alias(f"{c}_{d}") for d in fv.RANK_TYPES for c in ANSWER_FIELDS],
    )


def request_maintenance(requests: DataFrame, as_of: datetime | Column, days: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(remaining requests, status counts, timeout alert) after the timeout sweep and the retention delete."""
    late = requests.filter(mutations.timed_out(as_of))
    swept = mutations.sweep_timeouts(requests, as_of=as_of)
    kept = mutations.retention_delete(swept, as_of=as_of, days=days)
    return kept, aggregates.queue_stats(kept, as_of), aggregates.timeout_alert(late)


def incremental_articles(
    list_pages: DataFrame, stored: DataFrame, scraped_at: datetime | Column, span: int = 1_000_000
) -> DataFrame:
    """Records of new articles from list versions that changed.

    Titles of changed list versions that are not stored yet are looked up among
    the saved pages by the id in their link.
    """
    versions = page_source.list_fingerprints(list_pages)
    changed = windows.fingerprint_changed(versions, ["list_key"], "page_id", span=span).filter("changed")
    fresh = list_pages.join(changed.select("page_id"), "page_id", "left_semi")
    articles = page_source.extract_article(
        fresh.select("page_id", "url", "html"),
        base_url=F.regexp_extract("url", r"^(https?://[^/?#]+)", 1),
        scraped_at=scraped_at,
    )
    return sinks.article_rows(joins.new_titles(articles, stored), scraped_at)


def ops_dashboard(activity: DataFrame, as_of: datetime | Column) -> DataFrame:
    """One line per server: totals, current name, age of the last activity, symbol."""
    latest = F.max_by(F.struct("character_name", "outcome"), F.struct("logged_at", "task_id"))
    per_server = activity.groupBy("server_name").agg(
        F.count_if(F.col("outcome") != "pending").alias("processed"),
        F.count_if(F.col("outcome") == "pending").alias("remaining"),
        F.count_if(F.col("outcome") == "failed").alias("errors"),
        F.max("logged_at").alias("last_update"),
        latest.alias("latest"),
        F.count_if(F.col("logged_at") >= fn.moment(as_of) - fn.seconds(3600)).alias("last_hour"),
    )
    state = worker_state(F.col("latest.outcome"))
    return per_server.select(
        "server_name",
        state.alias("status"),
        fn.status_symbol(state).alias("symbol"),
        fn.ellipsize(F.coalesce(F.col("latest.character_name"), F.lit(fv.IDLE_LABEL)), 16, 13).alias("current_name"),
        fn.thousands(F.col("processed")).alias("processed"),
        fn.thousands(F.col("remaining")).alias("remaining"),
        "errors",
        fn.relative_age(F.col("last_update"), as_of).alias("last_update_age"),
        "last_hour",
    )


def worker_state(outcome: Column) -> Column:
    return F.when(outcome == "failed", "error").when(outcome == "pending", "waiting").otherwise("running")


def crawler_status(activity: DataFrame) -> DataFrame:
    """One status row per server from the activity log."""
    latest = F.max_by(F.struct("worker_id", "character_name", "outcome"), F.struct("logged_at", "task_id"))
    rows = activity.groupBy("server_name").agg(
        latest.alias("l"),
        F.count_if(F.col("outcome") != "pending").cast("int").alias("characters_processed"),
        F.count_if(F.col("outcome") == "pending").cast("int").alias("characters_remaining"),
        F.max("logged_at").alias("last_update"),
        F.count_if(F.col("outcome") == "failed").cast("int").alias("errors_count"),
        F.min("logged_at").alias("start_time"),
    )
    return rows.select(
        "server_name",
        F.col("l.worker_id").alias("worker_id"),
        worker_state(F.col("l.outcome")).alias("status"),
        F.col("l.character_name").alias("current_character"),
        "characters_processed",
        "characters_remaining",
        "last_update",
        "errors_count",
        "start_time",
    )
