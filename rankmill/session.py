"""Session builder and the shared work folder used for checkpoints, versioned tables and stream state."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName("rankmill")
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    A machine-local folder is acceptable only where driver and executors are
    one process, so any other master without the setting is refused.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="rankmill-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A new, never reused path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the Hadoop API."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate results in the shared folder."""
    system, place = hadoop_path(spark, path)
    system.delete(place, True)


_scopes = threading.local()  # micro-batches of several streams run in threads of their own


def _open_scopes() -> list[list[str]]:
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    return _scopes.open


@contextmanager
def settled_scope(spark: SparkSession):
    """Tables settled inside are removed at the end: for jobs that have written their results by then."""
    paths: list[str] = []
    _open_scopes().append(paths)
    try:
        yield
    finally:
        _open_scopes().pop()
        for path in paths:
            remove(spark, path)


def settle(df: DataFrame, **options) -> DataFrame:
    """Write an intermediate result once to the shared folder and go on from the files.

    Used where a result is read several times (an aggregate feeding several
    totals, a loop round) so that neither a retry nor a second reader repeats
    the work below it, and where row identity must not change between readers.
    A columnar table instead of a checkpoint: readers take the columns they
    need, and its size is known, so a small one can be broadcast.
    """
    spark = df.sparkSession
    path = work_path(spark, "settled")
    if _open_scopes():
        _open_scopes()[-1].append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_last(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """Settles what `make` returns and removes the tables that were settled on the way to it."""
    outer = list(_open_scopes())
    with settled_scope(spark):
        found = settle(make())
        kept = _open_scopes()[-1].pop()
    if outer:
        outer[-1].append(kept)
    return found
