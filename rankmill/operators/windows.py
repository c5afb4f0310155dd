"""First row per key, numbering, comparison with the previous row.

`row_number() = 1` is planned with a group limit on both sides of the shuffle,
so a hot key sends at most one row per map task. Numbering and look-back over
long groups are split by ranges, never done by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill import fixed_values as fv
from rankmill.session import settle


def first_per_key(frame: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order_by)
    return frame.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def distinct_on_key(frame: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    return first_per_key(frame, keys, order_by)


def latest_per_character(ranking: DataFrame) -> DataFrame:
    """Newest row of each (server, div, name) without the placeholder."""
    named = ranking.filter(F.col("character_name") != fv.PLACEHOLDER_NAME)
    order = [F.desc("retrieved_at"), F.asc("rank_position")]
    return first_per_key(named, ["server_name", "div", "character_name"], order)


def bottom_rank_ties(ranking: DataFrame) -> DataFrame:
    """All rows holding the highest rank number of their server, by window rank."""
    window = Window.partitionBy("server_name").orderBy(F.desc_nulls_last("rank_position"))
    return (
        ranking.filter(F.col("rank_position").isNotNull())
        .withColumn("_r", F.rank().over(window))
        .filter("_r = 1")
        .drop("_r")
    )


def first_seen(rows: DataFrame, key: str = "character", page: str = "page_seq", pos: str = "pos") -> DataFrame:
    """First occurrence of each name over an ordered sequence of pages; empty names dropped."""
    named = rows.filter((F.col(key) != "") & F.col(key).isNotNull())
    return first_per_key(named, [key], [F.asc(page), F.asc(pos)])


def first_match_per_type(rows: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    return first_per_key(rows, [*keys, "div"], order_by)


def numbered(
    frame: DataFrame,
    order_by: Sequence[Column],
    partition_by: Sequence[str] = (),
    name: str = "row_no",
) -> DataFrame:
    """1-based position in a total order, per group or over all rows, without a one-task window.

    A global sort spreads the rows by range; a row's position is its place in
    its slice plus the rows of the slices before. The sorted rows are written
    to the shared folder first, so a lost executor cannot renumber them.
    Only the slice counts (one row per slice) meet in one task. Group starts
    are the smallest position of each group.
    """
    seq = F.monotonically_increasing_id()
    ordered = settle(frame.orderBy(*partition_by, *order_by).withColumn("_seq", seq))
    in_slice = F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1))
    ordered = ordered.withColumn("_slice", F.shiftright("_seq", 33))
    counts = ordered.groupBy("_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(
        F.sum("_rows").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    starts = settle(counts.select("_slice", before.alias("_before")))
    placed = ordered.join(starts, "_slice").withColumn("_pos", F.col("_before") + in_slice + 1)
    if partition_by:
        first = settle(placed.groupBy(*partition_by).agg((F.min("_pos") - 1).alias("_start")))
        same = [placed[key].eqNullSafe(first[key]) for key in partition_by]
        condition = same[0]
        for term in same[1:]:
            condition = condition & term
        first_cols = placed.join(first, condition).select(*[placed[c] for c in placed.columns], first["_start"])
        placed = first_cols.withColumn("_pos", F.col("_pos") - F.col("_start"))
    return placed.select(*frame.columns, F.col("_pos").alias(name))


def assign_batches(
    frame: DataFrame, order_by: Sequence[Column], size: int, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Fixed-size batches in order: 0-based batch index and the number of batches of the group."""
    rows = settle(numbered(frame, order_by, partition_by))
    rows = rows.withColumn("batch_index", F.floor((F.col("row_no") - 1) / size))
    last = (F.max("batch_index") + 1).alias("batch_count")
    if not partition_by:
        return rows.withColumn("batch_count", rows.agg(last).scalar())
    return rows.join(rows.groupBy(*partition_by).agg(last), list(partition_by))


def report_index(report: DataFrame, value: str = "population", label: str = "class_name") -> DataFrame:
    """1-based index by value, largest first, ties by label; input holds one row per class code."""
    window = Window.orderBy(F.desc(value), F.asc(label))
    return report.withColumn("idx", F.row_number().over(window))


def previous_value(
    frame: DataFrame, keys: Sequence[str], order: str, value: str, name: str, span: int = 1_000_000
) -> DataFrame:
    """The value of the row before, per key in the order of a unique whole number.

    A key is cut into spans of the order number. Inside a span an ordinary lag
    does it; only the first row of a span takes the last value of the nearest
    span before, from a table with one row per (key, span).
    """
    cut = frame.withColumn("_span", F.call_function("div", F.col(order), F.lit(span)))
    inside = Window.partitionBy(*keys, "_span").orderBy(order)
    lagged = cut.withColumn("_inside", F.lag(F.struct(F.col(value).alias("v"))).over(inside))
    ends = cut.groupBy(*keys, "_span").agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("_end"))
    across = Window.partitionBy(*keys).orderBy("_span")
    carried = ends.select(*keys, "_span", F.lag("_end").over(across).alias("_carried"))
    joined = lagged.join(carried, [*keys, "_span"], "left")
    kept = [c for c in frame.columns]
    return joined.select(*kept, F.coalesce("_inside", "_carried")["v"].alias(name))


def fingerprint_changed(
    versions: DataFrame, keys: Sequence[str], order: str, fingerprint: str = "fingerprint", span: int = 1_000_000
) -> DataFrame:
    """Adds `changed`: differs from the version before; the first version counts as changed."""
    versions = settle(versions)  # read twice below, and computing a fingerprint reads a page
    seen = previous_value(versions, keys, order, fingerprint, "previous", span)
    return seen.withColumn("changed", ~F.col(fingerprint).eqNullSafe(F.col("previous")))


def share_of_total(frame: DataFrame, value: str = "population", name: str = "share") -> DataFrame:
    frame = settle(frame)
    total = frame.agg(F.sum(value)).scalar()
    return frame.withColumn(name, F.col(value) / total)
