"""Run registered queries against their SQL twins: python -m checks.compare [sf_dir] [names...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb

from checks.queries import ORACLES, QUERIES
from hostlens.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def as_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, folder: str) -> str:
    df = QUERIES[name](spark, folder)
    got = as_rows(df.columns, df.collect())
    if name not in ORACLES:
        return f"rows only ({len(got)})"
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = as_rows(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"MISMATCH columns {sorted(set(df.columns) ^ set(columns))}"
    if len(got) != len(want):
        return f"MISMATCH rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    types = {c: t for c, t in zip(columns, (str(d[1]) for d in cur.description))}
    kinds = {c: t for c, t in df.dtypes}
    odd = [
        (c, kinds[c], types[c]) for c in columns
        if {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}.get(kinds[c], kinds[c]) != types[c]
    ]
    note = f" types {odd}" if odd else ""
    return (f"MISMATCH {len(bad)} of {len(got)}: {bad[0]}" if bad else f"ok ({len(got)})") + note


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        master=f"local[{os.environ.get('BENCH_CPUS', '8')}]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            result = compare(spark, con, name, folder)
        except Exception as problem:
            result = "ERROR " + "".join(traceback.format_exception_only(problem))[:1500]
        failed += result.startswith(("MISMATCH", "ERROR"))
        print(f"{name:32s} {time.time() - start:6.2f}s {result}", flush=True)
    print(f"{len(names) - failed} of {len(names)} fine")


if __name__ == "__main__":
    main()
