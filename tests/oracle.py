"""Runs registered queries next to their SQL and compares the rows.

``python -m tests.oracle [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


_KIND = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
    "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]", "array<bigint>": "BIGINT[]",
}


def compare(spark, db, folder, run, sql):
    """None when schema and rows agree, else a short reason."""
    frame = run(spark, folder)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return None if got else "no rows"
    answer = db.execute(sql)
    columns = [d[0] for d in answer.description]
    want = rows_of(columns, answer.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    kinds = {d[0]: str(d[1]) for d in answer.description}
    for field in frame.schema.fields:
        mine = _KIND.get(field.dataType.simpleString(), field.dataType.simpleString())
        if mine != kinds[field.name]:
            return f"type of {field.name}: {mine} != {kinds[field.name]}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}"
    return None if got else "no rows"


def main(names):
    from loomgraph.catalog import REGISTERED
    from loomgraph.session import build_session

    folder = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", shuffle_partitions=8, spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    bad = 0
    for name, q in REGISTERED.items():
        if names and name not in names:
            continue
        begin = time.time()
        try:
            reason = compare(spark, db, folder, q.run, q.sql)
        except Exception as error:  # report and go on
            reason = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += reason is not None
        print(f"{'ok ' if reason is None else 'BAD'} {name:32s} {time.time() - begin:6.1f}s "
              f"{'' if q.sql else '(no sql) '}{reason or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(set(sys.argv[1:])) and 1)
