"""Joins. Right sides are reduced to one row per key before any join."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill import fixed_values as fv
from rankmill import functions as fn
from rankmill.operators.aggregates import complete_types
from rankmill.schemas import CHARACTER_KEY, RANKING_KEY, REQUEST_KEY
from rankmill.session import settle


def bottom_per_server(ranking: DataFrame) -> DataFrame:
    """Every row holding its server's highest rank number: ties stay, rank types are mixed."""
    ranking = settle(ranking)  # read twice below
    lowest = ranking.groupBy("server_name").agg(F.max("rank_position").alias("rank_position"))
    return ranking.join(lowest, ["server_name", "rank_position"]).select(ranking.columns)


def stale_not_in(ranking: DataFrame, as_of: datetime | Column) -> DataFrame:
    """Names with no row today and their newest time, with NOT IN's rule on nulls.

    A null name among today's rows of a server makes NOT IN undecided for all
    other names, so such a server yields nothing. One aggregation replaces the
    subquery: a name is untouched today exactly when its newest row is older.
    """
    now = F.col("retrieved_at") >= fn.day_start(as_of)
    names = settle(
        ranking.groupBy("server_name", "character_name").agg(
            F.max("retrieved_at").alias("last_retrieved"), F.count_if(now).alias("_today")
        )
    )
    unnamed = F.when(F.col("character_name").isNull(), F.col("_today")).otherwise(0)
    servers = names.groupBy("server_name").agg(F.sum("_today").alias("_touched"), F.sum(unnamed).alias("_undecided"))
    decided = (F.col("_undecided") == 0) & (F.col("character_name").isNotNull() | (F.col("_touched") == 0))
    return (
        names.filter("_today = 0")
        .join(servers, "server_name")
        .filter(decided)
        .select("server_name", "character_name", "last_retrieved")
    )


def new_titles(articles: DataFrame, stored: DataFrame) -> DataFrame:
    return articles.join(stored.select("title").distinct(), "title", "left_anti").select(articles.columns)


def decode_dims(rows: DataFrame, server_id: str, server_name: str, rank_type: str) -> DataFrame:
    """Server number <-> name and rank type <-> name by the fixed code lists."""
    by_name = {name: number for number, name in fv.SERVER_NAMES.items()}
    div_by_name = {name: number for number, name in fv.RANK_TYPE_NAMES.items()}
    type_name = F.coalesce(
        fn.lookup(fv.RANK_TYPE_NAMES, F.col(rank_type)),
        F.concat(F.lit(fv.OTHER_RANK_TYPE_PREFIX), F.col(rank_type).cast("string")),
    )
    return rows.select(
        "*",
        fn.lookup(fv.SERVER_NAMES, F.col(server_id), fv.SERVER_NAMES[1]).alias("decoded_server"),
        fn.lookup(by_name, F.col(server_name)).alias("decoded_server_id"),
        type_name.alias("rank_type_name"),
        fn.lookup(div_by_name, type_name).alias("decoded_div"),
    )


def updated_today_semi(keys: DataFrame, ranking: DataFrame, as_of: datetime | Column) -> DataFrame:
    """The keys that have a row since local midnight."""
    today = ranking.filter(F.col("retrieved_at") >= fn.day_start(as_of)).select(*CHARACTER_KEY).distinct()
    return keys.join(today, CHARACTER_KEY, "left_semi")


SUB_SLOTS = 64


def nearest_request(probes: DataFrame, targets: DataFrame, window: int, *, later: bool = False) -> DataFrame:
    """probes with `near`: of the targets of the same key the last one before each, or with `later` the first one from it on.

    Both carry the request key, created_at and request_id. Only targets less than
    `window` away are wanted, so time is cut into sub-slots, SUB_SLOTS to a window:
    a (key, sub-slot) is a group of its own, and for its first probes one target
    is carried over from the nearest sub-slot that has any. The table of these has
    a row per (key, sub-slot) and is looked through in slots as long as the window,
    so a key that has all rows in one window is still spread over SUB_SLOTS groups.
    """
    width = max(window // SUB_SLOTS, 1)
    per_slot = -(-window // width)
    sub = fn.time_slot(F.col("created_at"), width)
    slot = F.floor(F.col("_sub") / per_slot)
    side = F.struct("created_at", "request_id")
    probes = probes.withColumn("_sub", sub)
    targets = targets.withColumn("_sub", sub)
    both = targets.withColumn("_target", side).unionByName(
        probes.withColumn("_target", F.lit(None).cast("struct<created_at:timestamp_ntz,request_id:string>"))
    )
    is_target = F.col("_target").isNotNull()
    if later:  # read backwards in time; a target at the probe's own time counts
        order = [F.desc("created_at"), F.desc(is_target), F.desc("request_id")]
    else:
        order = [F.asc("created_at"), F.asc("request_id"), F.asc(is_target)]

    def before(group: list[str], order: list[Column]) -> Window:
        return Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    seen = F.last("_target", ignorenulls=True).over(before([*REQUEST_KEY, "_sub"], order))
    inside = both.withColumn("_inside", seen).filter(~is_target)
    edge = F.min(side) if later else F.max(side)
    edges = targets.groupBy(*REQUEST_KEY, "_sub").agg(edge.alias("_edge"))
    edges = edges.withColumn("_slot", F.explode(F.array(slot, slot - 1 if later else slot + 1)))
    places = probes.select(*REQUEST_KEY, "_sub").distinct().withColumn("_slot", slot)
    marks = edges.unionByName(places, allowMissingColumns=True)
    is_edge = F.col("_edge").isNotNull()
    along = [F.desc("_sub") if later else F.asc("_sub"), F.asc(is_edge)]
    carried = marks.withColumn("_carried", F.last("_edge", ignorenulls=True).over(before([*REQUEST_KEY, "_slot"], along)))
    carried = carried.filter(~is_edge).select(*REQUEST_KEY, "_sub", "_carried")
    same = F.lit(True)
    for key in [*REQUEST_KEY, "_sub"]:
        same = same & F.col(f"p.{key}").eqNullSafe(F.col(f"c.{key}"))
    return (
        inside.alias("p")
        .join(carried.alias("c"), same, "left")
        .select(*[F.col(f"p.{c}") for c in probes.columns if c != "_sub"], F.coalesce("_inside", "_carried").alias("near"))
    )


def open_request_within(incoming: DataFrame, stored: DataFrame, window: int = fv.DEDUP_SECONDS) -> DataFrame:
    """For every incoming request the newest open request of its key less than `window` before it; no pairs are formed."""
    columns = [*REQUEST_KEY, "created_at", "request_id"]
    opened = stored.filter(F.col("status").isin(*fv.OPEN_STATUSES)).select(*columns)
    matched = nearest_request(incoming.select(*columns), opened, window)
    recent = F.col("near.created_at") > F.col("created_at") - fn.seconds(window)
    return matched.select(
        "request_id",
        *REQUEST_KEY,
        "created_at",
        F.when(recent, F.col("near.request_id")).alias("open_request_id"),
    )


def population_by_recheck(stored: DataFrame, scraped: DataFrame) -> DataFrame:
    """Stored bottom rank against the rank just read of the same character; the smaller one counts."""
    fresh = scraped.groupBy(*CHARACTER_KEY).agg(F.min("rank_position").alias("_fresh"))
    joined = stored.join(fresh, CHARACTER_KEY, "left")
    return joined.select(
        "server_name",
        "character_name",
        F.least("rank_position", F.coalesce("_fresh", "rank_position")).alias("population"),
    )


def reconcile_saved(batch: DataFrame, state: DataFrame, slack: int = 60) -> DataFrame:
    """Per batch: rows given, rows really present since just before the batch, and whether they differ."""
    present = state.select(*RANKING_KEY, F.col("retrieved_at").alias("_saved_at"))
    found = F.col("_saved_at") >= F.col("batch_time") - fn.seconds(slack)
    return (
        batch.join(present, RANKING_KEY, "left")
        .groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("given"), F.count_if(found).alias("saved"))
        .withColumn("mismatch", F.col("given") != F.col("saved"))
    )


def class_category(rows: DataFrame, column: str = "class_name") -> DataFrame:
    category = {name: pair[0] for name, pair in fv.CLASS_COLOURS.items()}
    colour = {name: pair[1] for name, pair in fv.CLASS_COLOURS.items()}
    default_category, default_colour = fv.DEFAULT_CLASS_COLOUR
    return rows.withColumn("category", fn.lookup(category, F.col(column), default_category)).withColumn(
        "colour", fn.lookup(colour, F.col(column), default_colour)
    )


def latest_date_rows(snapshots: DataFrame, date: str | None = None) -> DataFrame:
    """Rows of the given date, or of the newest one."""
    wanted = F.lit(date).cast("date") if date else snapshots.agg(F.max("date")).scalar()
    return snapshots.filter(F.col("date") == wanted)


def prefer_source(primary: DataFrame, secondary: DataFrame, not_found: DataFrame | None = None) -> DataFrame:
    """The primary answer where it has all rank types, else the secondary.

    A name the primary source definitely does not know gets no fallback.
    """
    complete = settle(complete_types(primary).filter("all_present").select(*CHARACTER_KEY))
    fallback = secondary.join(complete, CHARACTER_KEY, "left_anti")
    if not_found is not None:
        fallback = fallback.join(not_found.select(*CHARACTER_KEY).distinct(), CHARACTER_KEY, "left_anti")
    first = primary.join(complete, CHARACTER_KEY, "left_semi").withColumn("source", F.lit("primary"))
    return first.unionByName(fallback.withColumn("source", F.lit("secondary")))


def batch_first_seen(batch: DataFrame, processed: DataFrame) -> DataFrame:
    """Rows of a batch whose `server_name_div` key was not handled yet."""

    def key() -> Column:
        return fn.compose_key(F.col("server_name"), F.col("character_name"), F.col("div"))

    done = processed.select(key().alias("character_key")).distinct()
    return batch.withColumn("character_key", key()).join(done, "character_key", "left_anti")
