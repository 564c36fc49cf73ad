"""Run registered queries next to their SQL on DuckDB: ``python check.py [sf] [name ...]``."""

import sys
import time

import duckdb
import pandas as pd

from harborline.plans import catalog
from harborline.session import build_session
from harborline.sources.domain import BASE_TABLES


def plain(value):
    if isinstance(value, float) and value != value:
        return None
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(name, spark, sf_dir, con):
    query = catalog.QUERIES[name]
    start = time.time()
    df = query.run(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    doubles = sorted(f.name for f in df.schema.fields if f.dataType.typeName() == "double")
    loose = [c for c in doubles if c not in query.doubles]
    sql = query.statement()
    if sql is None:
        return f"rows only  {len(got)} rows", took, loose, True
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} / {sorted(cols)}", took, loose, False
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return f"equal      {len(a)} rows", took, loose, True
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    return f"DIFFERENT  {len(a)} / {len(b)} rows, {len(diff)} differ\n   {diff[:2]}", took, loose, False


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(catalog.QUERIES)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    bad = []
    for name in names:
        try:
            text, took, loose, ok = compare(name, spark, sf_dir, con)
        except Exception as e:
            text, took, loose, ok = f"FAILED {type(e).__name__} {str(e)[:600]}", 0, [], False
        if not ok:
            bad.append(name)
        print(f"{name:28s} {took:6.1f}s {text}" + (f"  unrounded: {loose}" if loose else ""), flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} fine; not fine: {bad}")


if __name__ == "__main__":
    main()
