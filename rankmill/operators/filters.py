"""Filters, predicates and row shapes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill import fixed_values as fv
from rankmill import functions as fn
from rankmill.operators.windows import first_per_key
from rankmill.session import settle
from rankmill.sources.pages import block, item_markup, no_data


def point_lookup(ranking: DataFrame, server, character, div) -> DataFrame:
    return ranking.filter(
        (F.col("server_name") == server) & (F.col("character_name") == character) & (F.col("div") == div)
    )


def fresh_since(as_of: datetime | Column, ttl: int = fv.FRESH_SECONDS) -> Column:
    """retrieved_at later than as_of - ttl, strictly."""
    return F.col("retrieved_at") > fn.moment(as_of) - fn.seconds(ttl)


def fresh_rows(ranking: DataFrame, as_of: datetime | Column, ttl: int = fv.FRESH_SECONDS) -> DataFrame:
    return ranking.filter(fresh_since(as_of, ttl))


def fresh_server_rows_min_count(
    ranking: DataFrame, as_of: datetime | Column, ttl: int = fv.FRESH_SECONDS, min_rows: int = fv.MIN_FRESH_ROWS
) -> DataFrame:
    """Fresh rows of every (server, div) that has at least `min_rows` of them."""
    fresh = settle(fresh_rows(ranking, as_of, ttl))  # read twice below
    enough = fresh.groupBy("server_name", "div").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows)
    return fresh.join(enough.drop("n"), ["server_name", "div"], "left_semi")


def outdated_rows(
    ranking: DataFrame,
    as_of: datetime | Column,
    ttl: int = fv.FRESH_SECONDS,
    limit: int = fv.OUTDATED_LIMIT,
) -> DataFrame:
    """The oldest rows beyond the ttl, at most `limit`, in a fixed order."""
    old = ranking.filter(F.col("retrieved_at") < fn.moment(as_of) - fn.seconds(ttl))
    return old.orderBy("retrieved_at", "server_name", "character_name", "div").limit(limit)


def drop_placeholder_names(rows: DataFrame, column: str = "character") -> DataFrame:
    return rows.filter(F.col(column) != fv.PLACEHOLDER_NAME)


def status_in(requests: DataFrame, statuses: Sequence[str] = fv.OPEN_STATUSES) -> DataFrame:
    return requests.filter(F.col("status").isin(*statuses))


def name_like(rows: DataFrame, pattern: str, column: str = "character_name") -> DataFrame:
    return rows.filter(F.col(column).like(pattern))


def trim_equal_match(rows: DataFrame, wanted: DataFrame, order_by: Sequence[Column]) -> DataFrame:
    """Rows whose trimmed server and character equal a wanted pair; first hit per rank type."""
    left = rows.withColumn("server", F.trim("server")).withColumn("character", F.trim("character"))
    right = wanted.select(F.trim("server").alias("server"), F.trim("character").alias("character")).distinct()
    hits = left.join(right, ["server", "character"], "left_semi")
    return first_per_key(hits, ["server", "character", "div"], order_by)


def class_rows_only(snapshots: DataFrame) -> DataFrame:
    return snapshots.filter((F.col("server_name") == fv.ALL_LABEL) & (F.col("class_name") != fv.ALL_LABEL))


def to_api_shape(ranking: DataFrame) -> DataFrame:
    """Stored row -> answer row, with defaults for missing values."""
    zero = F.lit(0)
    return ranking.select(
        fn.thousands(F.coalesce("rank_position", zero), fv.RANK_SUFFIX).alias("rank"),
        F.coalesce("class_name", F.lit("")).alias("class"),
        fn.thousands(F.coalesce("power_value", zero)).alias("power"),
        F.coalesce("change_amount", zero).alias("change"),
        F.coalesce("server_name", F.lit("")).alias("server"),
        F.coalesce("character_name", F.lit("")).alias("character"),
        F.coalesce("change_type", F.lit("none")).alias("change_type"),
        "div",
    )


def _has_answer(result: Column) -> Column:
    """The result is a JSON object with both `data` and `success` (a null value counts as present)."""
    keys = F.json_object_keys(result)
    return F.coalesce(F.array_contains(keys, "data") & F.array_contains(keys, "success"), F.lit(False))


def request_status_view(requests: DataFrame) -> DataFrame:
    """What a client polling a request gets, by status."""
    state, result = F.col("status"), F.col("result")
    done = (state == "completed") & result.isNotNull()
    answered = done & _has_answer(result)
    fallback = F.concat(F.lit(fv.OTHER_STATUS_MESSAGE_PREFIX), state)
    return requests.select(
        "request_id",
        "status",
        F.when(~done, F.col("server")).alias("server"),
        F.when(~done, F.col("character_name")).alias("character_name"),
        F.when(answered, F.coalesce(F.get_json_object(result, "$.success") == "true", F.lit(False)))
        .when(done, F.lit(True))
        .otherwise(state.isin("processing", "pending"))
        .alias("success"),
        F.when(answered, fn.json_path_default(result, "$.message", ""))
        .when(~done, F.coalesce(fn.lookup(fv.STATUS_MESSAGES, state), fallback))
        .alias("message"),
        F.when(answered, F.get_json_object(result, "$.data")).alias("character_json"),
        F.when(answered, F.coalesce(F.get_json_object(result, "$.from_cache") == "true", F.lit(False))).alias(
            "from_cache"
        ),
        F.when(done & ~answered, result).alias("raw_result"),
        F.when(~done & ~state.isin("processing", "pending"), F.col("error_message")).alias("error"),
        F.when(state == "failed", F.col("retry_count")).alias("retry_count"),
        F.when(state == "processing", F.col("started_at")).alias("started_at"),
        F.when(state == "pending", F.col("created_at")).alias("created_at"),
        F.when(done, F.col("completed_at")).alias("completed_at"),
    )


def flatten_result(requests: DataFrame) -> DataFrame:
    """Lifts data, message, success and from_cache out of the nested result."""
    result = F.col("result")
    nested = _has_answer(result)
    return requests.filter(result.isNotNull()).select(
        "request_id",
        F.when(nested, F.get_json_object(result, "$.success") == "true").alias("success"),
        F.when(nested, fn.json_path_default(result, "$.message", "")).alias("message"),
        F.when(nested, F.coalesce(F.get_json_object(result, "$.from_cache") == "true", F.lit(False))).alias(
            "from_cache"
        ),
        F.when(nested, F.get_json_object(result, "$.data")).alias("character_json"),
        F.when(~nested, result).alias("raw_result"),
    )


def parsed_rows(scraped: DataFrame, change_rule: str = "plain") -> DataFrame:
    """Typed columns next to the scraped text; null where a number does not parse."""
    change_type = F.col("change_type") if "change_type" in scraped.columns else fn.change_type_of(F.col("css"))
    amount = fn.parse_change_plain(F.col("change"))
    if change_rule == "digits":
        amount = fn.parse_change_digits(F.col("change"))
    return scraped.withColumns(
        {
            "rank_position": fn.parse_rank_power(F.col("rank"), "int"),
            "change_amount": fn.signed_change(amount, change_type),
            "change_type": change_type,
            "server_name": fn.clean_text(F.col("server")),
            "character_name": fn.clean_text(F.col("character")),
            "class_name": fn.clean_text(F.col("class")),
            "power_value": fn.parse_rank_power(F.col("power")),
        }
    )


def parses() -> Column:
    return F.col("rank_position").isNotNull() & F.col("power_value").isNotNull() & F.col("change_amount").isNotNull()


def flag_valid_rows(scraped: DataFrame, change_rule: str = "plain") -> DataFrame:
    """Typed rows with `valid`: one pass, for callers that keep both kinds."""
    return parsed_rows(scraped, change_rule).withColumn("valid", parses())


def split_valid_rows(
    scraped: DataFrame, strict: bool = False, change_rule: str = "plain"
) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine); with `strict` one bad row fails the job instead."""
    if strict:
        typed = parsed_rows(scraped, change_rule)
        checked = F.when(parses(), F.col("rank_position")).otherwise(
            F.raise_error(F.concat(F.lit("row does not parse: "), F.to_json(F.struct("rank", "change", "power"))))
        )
        return typed.withColumn("rank_position", checked), typed.limit(0)
    flagged = settle(flag_valid_rows(scraped, change_rule))  # read twice below
    return flagged.filter("valid").drop("valid"), flagged.filter("NOT valid").drop("valid")


def needs_refresh(last_updated: Column, as_of: datetime | Column, ttl: int = fv.HOURLY_TTL_SECONDS) -> Column:
    return F.coalesce(fn.age_seconds(fn.moment(as_of), last_updated) >= ttl, F.lit(True))


def page_kind(html: Column) -> Column:
    """rows / no_data / not_found / empty; the not-found test runs only on pages without rows.

    A hit removes a name from the state, so the parts of the modal have to follow
    each other inside it, and all phrases have to stand in its message.
    """
    message = "".join(f"(?=(?:(?!</div>).)*{re.escape(phrase)})" for phrase in fv.NOT_FOUND_PHRASES)
    modal = "(?s)" + ".*?".join(
        [
            block("div", "modal_inner"),
            block("div", "modal_header"),
            block("div", "logo"),
            block("div", "modal_body"),
            block("div", "message") + message,
            block("div", "button_area"),
            block("button", "confirm_button"),
        ]
    )
    return (
        F.when(no_data(html), "no_data")
        .when(F.size(item_markup(html)) > 0, "rows")
        .when(html.rlike(modal), "not_found")
        .otherwise("empty")
    )


def challenge_page(html: Column) -> Column:
    """Interstitial: its title says so, or the markers of a list page are missing."""
    title = F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1)
    blocked = F.lit(False)
    for text in fv.CHALLENGE_TITLES:
        blocked = blocked | F.contains(title, F.lit(text))
    low = F.lower(html)
    marked = (
        html.rlike(r'<ul[^>]*class="([^"]* )?list( [^"]*)?"')
        | html.rlike(r'class="([^"]* )?list_area( [^"]*)?"')
        | (low.contains("ranking") & low.contains("list"))
    )
    return blocked | ~marked
