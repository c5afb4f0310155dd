"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill import fixed_values as fv
from rankmill import functions as fn
from rankmill.session import settle


def union_rollups(rows: DataFrame) -> DataFrame:
    """The cube as a union of four groupings of one count; kept as a check of `population_cube`."""
    base = settle(rows.groupBy("server_name", "class_name").agg(F.count(F.lit(1)).alias("n")))
    parts = []
    for keys in ([], ["class_name"], ["server_name"], ["server_name", "class_name"]):
        counted = base.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("population"))
        labels = [
            F.col(k).alias(k) if k in keys else F.lit(fv.ALL_LABEL).alias(k) for k in ("server_name", "class_name")
        ]
        parts.append(counted.select(*labels, "population", F.lit(1).alias("div")))
    return reduce(DataFrame.unionByName, parts)


def fan_in_rank_types(frames: dict[int, DataFrame | None]) -> DataFrame:
    """Union of the rank types' results with a type tag; a failed type (None) adds nothing."""
    parts = [
        frame.withColumn("rank_type", F.lit(fv.RANK_TYPE_NAMES.get(div, f"{fv.OTHER_RANK_TYPE_PREFIX}{div}")))
        for div, frame in frames.items()
        if frame is not None
    ]
    return reduce(DataFrame.unionByName, parts)


def tag_rank_types(rows: DataFrame) -> DataFrame:
    """The same tag for rows of all rank types in one frame, in one pass."""
    other = F.concat(F.lit(fv.OTHER_RANK_TYPE_PREFIX), F.col("div").cast("string"))
    return rows.withColumn("rank_type", F.coalesce(fn.lookup(fv.RANK_TYPE_NAMES, F.col("div")), other))


def distinct_rows(rows: DataFrame) -> DataFrame:
    return rows.dropDuplicates()


def title_difference(found: DataFrame, stored: DataFrame) -> DataFrame:
    return found.select("title").subtract(stored.select("title"))
