"""Run every registered query in Spark and its SQL in DuckDB and compare."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return str(value)
    return repr(value) if value is not None else "~"


def canonical(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark, con, sf_dir: str, name: str, fn, sql: str) -> tuple[str, int, float]:
    """Empty text when equal, rows, seconds."""
    start = time.time()
    frame = fn(spark, sf_dir)
    rows = frame.collect()
    seconds = time.time() - start
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}", len(rows), seconds
    types = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    duck = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    names = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN",
    }
    wrong = {c: (t, duck[c]) for c, t in types.items() if names.get(t) != duck[c]}
    a, b = canonical(frame.columns, rows), canonical(columns, expected)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:3]
        only_b = [x for x in b if x not in set(a)][:3]
        return f"rows {len(a)}/{len(b)} spark-only {only_a} sql-only {only_b} types {wrong}", len(rows), seconds
    return (f"types {wrong}" if wrong else ""), len(rows), seconds


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from __spark_entry__ import oracle_sql, queries
    from clearlane.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = connect(sf)
    oracle = oracle_sql()
    for name, fn in queries().items():
        if name not in oracle or wanted and name not in wanted:
            continue
        try:
            text, n, sec = differences(spark, con, sf, name, fn, oracle[name])
        except Exception as error:  # noqa: BLE001
            text, n, sec = f"{type(error).__name__}: {str(error)[:700]}", -1, 0.0
        print(f"{'ok ' if not text else 'BAD'} {name} rows={n} {sec:.2f}s {text}", flush=True)
