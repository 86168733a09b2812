"""Run registered queries beside their SQL in DuckDB and compare rows."""

from __future__ import annotations

import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: round(v, 4) + 0.0 if isinstance(v, float) else v
    return sorted(repr(tuple(fix(r[i]) for i in order)) for r in rows), sorted(names)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    got, names = canonical([tuple(r) for r in df.collect()], df.columns)
    rel = con.execute(sql)
    want, sql_names = canonical(rel.fetchall(), [d[0] for d in rel.description])
    if names != sql_names:
        return f"columns {names} / {sql_names}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"rows {len(got)} / {len(want)}; only here: {sorted(a)[:3]}; only in SQL: {sorted(b)[:3]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import time

    import __spark_entry__ as entry
    from lectern.session import local_session

    sf = sys.argv[1]
    spark = local_session(int(os.environ.get("CORES", 4)))
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    sql = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(a) for a in sys.argv[2:]):
            continue
        t = time.time()
        try:
            said = compare(spark, con, sf, fn, sql[name]) if name in sql else f"(no SQL) {fn(spark, sf).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {str(e)[:600]}"
        if said or os.environ.get("ALL"):
            print(f"{name} {time.time() - t:.1f}s: {said}"[:900], flush=True)
