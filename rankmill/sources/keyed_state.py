"""Current state kept as one parquet table, partitioned by a hash of its key.

A merge reads and rewrites only the buckets that its changes fall into, so it costs what the changes touch,
not what the state holds. Spark's dynamic partition overwrite puts the new buckets in place.

Order of a merge: the new buckets are written whole to `pending`, then over the old ones in `state`, then `pending`
goes. Whoever merges next finishes what an ended driver has left: a `pending` that is complete is put in place again, another
is dropped. Merging the same changes twice gives the same state. One merge at a time; readers between merges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankmill.operators.mutations import with_changes
from rankmill.operators.windows import first_per_key
from rankmill.session import hadoop_path, remove, settle

BUCKETS = 64


def path_exists(spark: SparkSession, path: str) -> bool:
    system, place = hadoop_path(spark, path)
    return system.exists(place)


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _bucketed(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])


def read_state(spark: SparkSession, root: str, schema: T.StructType, buckets: Sequence[int] | None = None) -> DataFrame:
    """The stored rows, of all buckets or of the given ones (the others' files are not opened); none before the first merge."""
    if not path_exists(spark, f"{root}/state"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(_bucketed(schema)).parquet(f"{root}/state")
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(*buckets) if buckets else F.lit(False))
    return rows.select(*schema.fieldNames())


def _number_of_buckets(spark: SparkSession, root: str, wanted: int) -> int:
    """What the state was made with; a new one is made with `wanted`."""
    if not path_exists(spark, f"{root}/layout/_SUCCESS"):
        made = spark.createDataFrame([(wanted,)], "buckets int").coalesce(1)
        made.write.mode("overwrite").json(f"{root}/layout")
    return spark.read.schema("buckets int").json(f"{root}/layout").first()["buckets"]


def _put_in_place(spark: SparkSession, root: str, schema: T.StructType) -> None:
    """Overwrites the buckets that are in `pending`, and removes it. An incomplete one goes unused."""
    if path_exists(spark, f"{root}/pending/_SUCCESS"):
        rows = spark.read.schema(_bucketed(schema)).parquet(f"{root}/pending")
        writer = rows.write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.parquet(f"{root}/state")
    if path_exists(spark, f"{root}/pending"):
        remove(spark, f"{root}/pending")


def merge_state(
    changes: DataFrame,
    root: str,
    *,
    schema: T.StructType,
    keys: Sequence[str],
    order_by: Sequence[Column],
    event_time: str | None = None,
    compete: bool = False,
    buckets: int = BUCKETS,
) -> list[int]:
    """Upserts changes into the state and returns the buckets that were rewritten, in order.

    Of several changes of a key the first in `order_by` counts. It wins over the stored row, with `event_time` only if it
    isn't older, with `compete` only if it comes first in `order_by` among the two. Only the numbers of the touched
    buckets, `buckets` at most, come to the driver.
    """
    spark = changes.sparkSession
    _put_in_place(spark, root, schema)
    buckets = _number_of_buckets(spark, root, buckets)
    newest = settle(first_per_key(changes, keys, order_by).select(*schema.fieldNames()))
    touched = sorted(row[0] for row in newest.select(bucket_of(keys, buckets)).distinct().collect())
    if touched:
        stored = read_state(spark, root, schema, touched)
        if compete:
            merged = first_per_key(stored.unionByName(newest), keys, order_by)
        else:
            merged = with_changes(stored, newest, keys, event_time)
        spread = merged.withColumn("bucket", bucket_of(keys, buckets)).hint("rebalance", "bucket")
        spread.write.partitionBy("bucket").mode("overwrite").parquet(f"{root}/pending")
        _put_in_place(spark, root, schema)
    return touched
