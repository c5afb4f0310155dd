"""Registration of queries with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankmill import fixed_values, views
from rankmill.catalog.sql_views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_fixed_values(sql: str) -> str:
    """Puts the values of fixed_values in: @NAME@, or @NAME.key@ for an entry of a table."""

    def value(match: re.Match) -> str:
        found, key = getattr(fixed_values, match[1]), match[2]
        return str(found if key is None else found[int(key) if key.isdigit() else key])

    return re.sub(r"@([A-Z_]+)(?:[.]([^@]+))?@", value, sql)


class Inputs:
    """The views over one data folder, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return views.table(self.spark, self.sf_dir, name)

    def stream(self, name: str) -> DataFrame:
        return views.table_stream(self.spark, self.sf_dir, name)

    def __getattr__(self, name: str):
        """`inputs.ranking` is views.ranking(spark, sf_dir), kept for the next use."""
        value = getattr(views, name)(self.spark, self.sf_dir)
        setattr(self, name, value)
        return value

    @property
    def as_of(self):
        return self.latest_observation

    @property
    def event_as_of(self):
        return self.latest_event


def query(name: str, sql: str | None = None):
    """Registers fn(inputs) under `name`; `sql` may use the views of sql_views by name."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(with_fixed_values(sql))
        return fn

    return register
