"""Run registered queries and their SQL side by side: python -m tests.oracle [sf_dir] [name ...]."""

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def sort_key(row):
    return [(v is None, str(type(v)) if v is None else "", v if v is not None else 0) for v in row]


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(normal(r[i]) for i in order) for r in rows), key=sort_key)


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    began = time.time()
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    middle = time.time()
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    print(f"  [collect {middle - began:.1f}s, SQL {time.time() - middle:.1f}s]", end=" ")
    if names != want_names:
        return f"columns {names} / {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}: first {got[:2]} / {want[:2]}"
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        return f"{len(bad)} of {len(got)} rows differ, first {bad[:2]}"
    return None


def main():
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tests.session import make_session
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con = make_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        began = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, queries[name], oracles[name], sf_dir)
                note = "ok" if problem is None else problem
            else:
                problem, note = None, f"{queries[name](spark, sf_dir).count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            problem = note = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name}: {time.time() - began:.1f}s {note}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
