"""Explicit schemas: the input tables and the data sets built from them."""

from pyspark.sql import types as T


TYPES = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _struct(columns: str) -> T.StructType:
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


TABLES = {
    "region": _struct("r_regionkey int, r_name string"),
    "nation": _struct("n_nationkey int, n_name string, n_regionkey int"),
    "customer": _struct(
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "orders": _struct(
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "events": _struct(
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
    "pages": _struct("page_id bigint, url string, html string"),
}

RANKING = _struct(
    "rank_position int, change_amount int, change_type string, server_name string, "
    "character_name string, class_name string, power_value bigint, div int, "
    "retrieved_at timestamp_ntz"
)

# column order of the tab separated bulk load
STAGING = _struct(
    "rank_position int, change_amount int, change_type string, server_name string, "
    "character_name string, class_name string, power_value bigint, div int, "
    "retrieved_at timestamp_ntz, corrupt_record string"
)

# what the stream of list versions remembers of each list
LAST_FINGERPRINT = _struct("list_key string, last_seen string, seen_before string, batch bigint")

RANKING_KEY = ["character_name", "server_name", "div"]
CHARACTER_KEY = ["server_name", "character_name"]
SNAPSHOT_KEY = ["date", "server_name", "class_name", "div"]
REQUEST_KEY = ["server", "character_name"]
