"""Compare registered queries with their SQL on DuckDB: names, types, values."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

TYPE = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "int": "INTEGER"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def canon(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return v


def compare(spark, con, sf_dir, name, fn, sql):
    """Return None when equal, else a description."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(canon(r[c]) for c in cols) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return None, len(rows), t1 - t0, 0.0
    cur = con.execute(sql)
    desc = {d[0]: str(d[1]) for d in cur.description}
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}", len(rows), t1 - t0, time.time() - t1
    order = [names.index(c) for c in cols]
    want = [tuple(canon(r[i]) for i in order) for r in cur.fetchall()]
    t2 = time.time()
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for c in cols:
        if TYPE.get(types[c], types[c]) != desc[c]:
            return f"type of {c}: {types[c]} vs {desc[c]}", len(rows), t1 - t0, t2 - t1
    if len(rows) != len(want):
        extra = list(set(map(repr, rows)) - set(map(repr, want)))[:2]
        less = list(set(map(repr, want)) - set(map(repr, rows)))[:2]
        return (f"rows {len(rows)} vs {len(want)} cols {cols}\n   +{extra}\n   -{less}",
                len(rows), t1 - t0, t2 - t1)
    a, b = sorted(rows, key=repr), sorted(want, key=repr)
    for x, y in zip(a, b):
        if x != y:
            return f"values {cols}\n   spark {x}\n   sql   {y}", len(rows), t1 - t0, t2 - t1
    return None, len(rows), t1 - t0, t2 - t1


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from boardlake.session import get_spark
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_spark("local[8]", 8, **{"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    pick = sys.argv[1:]
    bad = 0
    for name, fn in queries.items():
        if pick and not any(name == p or name.startswith(p) for p in pick):
            continue
        try:
            err, n, a, b = compare(spark, con, sf, name, fn, oracle.get(name))
        except Exception as e:  # report and go on with the next query
            err, n, a, b = f"{type(e).__name__}: {str(e)[:700]}", -1, 0, 0
        bad += err is not None
        note = "" if name in oracle else " (no sql)"
        flag = " EMPTY" if n == 0 else ""
        print(f"{'ok  ' if err is None else 'FAIL'} {name} rows={n}{flag} spark={a:.1f}s sql={b:.1f}s{note}"
              + (f"\n   {err}" if err else ""), flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
