"""Registered queries: a Spark query and the SQL that must give the same rows."""

from rankmill.catalog.registry import ORACLES, QUERIES  # noqa: F401
from rankmill.catalog import (  # noqa: F401
    aggregate_queries,
    filter_queries,
    function_queries,
    join_queries,
    job_queries,
    mutation_queries,
    source_queries,
    stream_queries,
    window_queries,
)
