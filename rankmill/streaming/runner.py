"""Starting streams and keeping their results in the shared folder.

Results go to files, never to the driver. Streams that change earlier results
(update mode) write every micro-batch to a folder named by its batch id: a
repeated batch overwrites its own folder, so a restart cannot count twice. Every FOLD_EVERY
batches the folders are merged into a bucketed state inside the stream, and folders that an earlier fold
has covered are removed, so readers meet a bounded number of them. Readers take the first row per key over both.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rankmill.operators.windows import first_per_key
from rankmill.session import hadoop_path, remove, settled_scope, work_path
from rankmill.sources.keyed_state import merge_state, path_exists, read_state

STREAM_CONF = {
    # state lives in RocksDB on the executors, outside the heap
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # one store per partition for a stream join instead of four
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


@contextmanager
def stream_conf(spark: SparkSession):
    """Settings a stream takes over when it starts; the session's own settings are put back.

    A stateful stream keeps the number of state partitions it starts with: it is
    the session's spark.sql.shuffle.partitions, to be set for the cluster's full size.
    """
    before = {key: spark.conf.get(key, None) for key in STREAM_CONF}
    for key, value in STREAM_CONF.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def start_append(frame: DataFrame, root: str, trigger: dict) -> StreamingQuery:
    writer = frame.writeStream.outputMode("append").format("parquet").option("path", f"{root}/rows")
    with stream_conf(frame.sparkSession):
        return writer.option("checkpointLocation", f"{root}/progress").trigger(**trigger).start()


FOLD_EVERY = 20


def start_batches(
    frame: DataFrame,
    root: str,
    trigger: dict,
    mode: str = "update",
    prepare=None,
    *,
    keys: Sequence[str],
    order_by: Sequence[Column] = (),
    fold_every: int = FOLD_EVERY,
) -> StreamingQuery:
    """Writes micro-batches to folders and folds them now and then; the newest row per key by `order_by` and batch is in force."""

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")
        if (batch_id + 1) % fold_every == 0:
            fold(batch.sparkSession, root, frame.schema, keys, order_by, batch_id, fold_every)

    return start_steps(frame, root, trigger, save, mode)


def start_steps(frame: DataFrame, root: str, trigger: dict, step, mode: str = "append") -> StreamingQuery:
    """Runs `step(batch, batch_id)` on every micro-batch; a step overwrites only folders named by its batch id."""
    writer = frame.writeStream.outputMode(mode).foreachBatch(step)
    with stream_conf(frame.sparkSession):
        return writer.option("checkpointLocation", f"{root}/progress").trigger(**trigger).start()


def finish(query: StreamingQuery) -> None:
    """Waits for an available-now stream to end; a failure is raised here."""
    query.awaitTermination()


AVAILABLE_NOW = {"availableNow": True}


def collect_append(frame: DataFrame, label: str) -> DataFrame:
    """Runs a stream over all available input and reads back what it appended."""
    root = work_path(frame.sparkSession, label)
    finish(start_append(frame, root, AVAILABLE_NOW))
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{root}/rows")


def collect_latest(
    frame: DataFrame, label: str, keys: Sequence[str], order_by: Sequence[Column] = (), prepare=None, mode: str = "update"
) -> DataFrame:
    """Runs a stream in update mode over all available input and reads the newest row per key."""
    root = work_path(frame.sparkSession, label)
    finish(start_batches(frame, root, AVAILABLE_NOW, mode, prepare, keys=keys, order_by=order_by))
    return latest_rows(frame.sparkSession, root, frame.schema, keys, order_by)


def _with_batch(schema) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch", T.LongType())])


def _folders(spark: SparkSession, root: str, schema) -> DataFrame:
    """The rows of the batch folders, none before the first batch."""
    if not path_exists(spark, f"{root}/rows"):
        return spark.createDataFrame([], _with_batch(schema))
    return spark.read.schema(_with_batch(schema)).parquet(f"{root}/rows")


def batch_folders(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the batches whose folders are there."""
    if not path_exists(spark, f"{root}/rows"):
        return []
    system, place = hadoop_path(spark, f"{root}/rows")
    names = [status.getPath().getName() for status in system.listStatus(place)]
    return sorted(int(name.removeprefix("batch=")) for name in names if name.startswith("batch="))


def latest_rows(spark: SparkSession, root: str, schema, keys: Sequence[str], order_by: Sequence[Column] = ()) -> DataFrame:
    """Newest row per key over the folded state and the batch folders; `order_by` comes before the batch number."""
    stored = read_state(spark, f"{root}/folded", _with_batch(schema)).unionByName(_folders(spark, root, schema))
    return first_per_key(stored, keys, [*order_by, F.desc("batch")]).drop("batch")


def fold(
    spark: SparkSession, root: str, schema, keys: Sequence[str], order_by: Sequence[Column], batch_id: int, kept: int = 0
) -> None:
    """Merges the batch folders up to `batch_id` into the folded state, then removes all but the last `kept` of them.

    Rows carry their batch, so folders that are merged once more, after a stop in between, change nothing. Those
    that stay serve readers that began before the fold.
    """
    with settled_scope(spark):
        merge_state(
            _folders(spark, root, schema).where(F.col("batch") <= batch_id),
            f"{root}/folded",
            schema=_with_batch(schema),
            keys=keys,
            order_by=[*order_by, F.desc("batch")],
            compete=True,
        )
    for number in batch_folders(spark, root):
        if number <= batch_id - kept:
            remove(spark, f"{root}/rows/batch={number}")
