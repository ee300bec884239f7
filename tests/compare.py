"""Run registered queries against their SQL on one folder of tables and compare."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return con


def canon(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return repr(value)
    return value


def difference(df, con, sql: str) -> str | None:
    """None if equal, else a short description."""
    spark_rows = df.collect()
    columns = sorted(df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != columns:
        return f"columns {columns} vs {sorted(names)}"
    duck_rows = cur.fetchall()
    key = lambda row: tuple((v is not None, str(type(v)), str(v)) for v in row)
    left = sorted((tuple(canon(r[c]) for c in columns) for r in spark_rows), key=key)
    order = [names.index(c) for c in columns]
    right = sorted((tuple(canon(r[i]) for i in order) for r in duck_rows), key=key)
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, e.g. {columns}: {str(bad[0][0])[:400]} vs {str(bad[0][1])[:400]}"
    return None


def main(path: str, wanted: list[str]) -> int:
    import pathlib

    sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from newslake.session import build_session

    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(path)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, path)
            problem = difference(df, con, sqls[name]) if name in sqls else None
            note = "" if name in sqls else f"rows only: {df.count()}"
        except Exception as exc:  # noqa: BLE001
            problem, note = f"{type(exc).__name__}: {str(exc)[:900]}", ""
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t0:.1f}s {problem or note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
