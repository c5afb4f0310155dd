"""Runs a registered query and its SQL on the same files and compares names, counts and values."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def family(kind: str) -> str:
    kind = kind.lower()
    for names, label in (
        (("int", "hugeint"), "whole"),
        (("double", "float"), "real"),
        (("decimal",), "decimal"),
        (("char", "string", "text"), "text"),
        (("timestamp", "datetime"), "time"),
    ):
        if kind.endswith("]") or kind.startswith(("array", "struct", "map")):
            return "nested"
        if any(n in kind for n in names):
            return label
    return kind.rstrip("ean") if kind.startswith("bool") else kind


def compare(spark, connection, name, spark_query, sql, sf_dir) -> tuple[bool, str]:
    started = time.time()
    frame = spark_query(spark, sf_dir)
    rows = [tuple(plain(v) for v in row) for row in frame.collect()]
    took = time.time() - started
    columns, kinds = [c for c, _ in frame.dtypes], dict(frame.dtypes)
    if sql is None:
        return True, f"{len(rows)} rows, no SQL, {took:.1f}s"
    started = time.time()
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    sql_kinds = {d[0]: str(d[1]) for d in result.description}
    expected = [tuple(plain(v) for v in row) for row in result.fetchall()]
    sql_took = time.time() - started
    if sorted(columns) != sorted(names):
        return False, f"columns {sorted(columns)} != {sorted(names)}"
    order = sorted(columns)
    got = sorted(repr([row[columns.index(c)] for c in order]) for row in rows)
    want = sorted(repr([row[names.index(c)] for c in order]) for row in expected)
    mismatch = [(c, kinds[c], sql_kinds[c]) for c in order if family(kinds[c]) != family(sql_kinds[c])]
    if got != want:
        only_got = [r for r in got if r not in set(want)][:2]
        only_want = [r for r in want if r not in set(got)][:2]
        return False, f"{len(got)} rows vs {len(want)}: {str(only_got)[:700]} | {str(only_want)[:700]}"
    if mismatch:
        return False, f"types {mismatch}"
    return True, f"{len(rows)} rows, {took:.1f}s (SQL {sql_took:.1f}s)"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from rankmill.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    connection, sqls = duck(sf_dir), oracle_sql()
    bad = 0
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        try:
            ok, note = compare(spark, connection, name, run, sqls.get(name), sf_dir)
        except Exception as error:  # a failing query must not hide the others
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        bad += not ok
        print("ok " if ok else "BAD", name, note, flush=True)
    print(f"{bad} bad of {len(queries()) if not wanted else len(wanted)}")


if __name__ == "__main__":
    main()
