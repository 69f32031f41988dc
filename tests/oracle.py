"""Compare registered queries with DuckDB on the same parquet files."""

import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


TIMES = {}


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if type(v).__name__ == "Decimal":
        return repr(float(v) + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(_norm(r[i])) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, fn, sql, sf):
    df = fn(spark, sf)
    t = time.time()
    got, gcols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    TIMES["spark"], t = time.time() - t, time.time()
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want, wcols = rows_of(cols, rel.fetchall())
    TIMES["duck"] = time.time() - t
    if gcols != wcols:
        return f"columns {gcols} != {wcols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)}/{len(got)} rows differ, first: {bad[0]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    from motifspark.registry import load_all
    from motifspark.session import local_session

    sf, wanted = sys.argv[1], sys.argv[2:]
    queries, oracles = load_all()
    spark, con = local_session(8), duck(sf)
    fails = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        TIMES.clear()
        t = time.time()
        try:
            if name in oracles:
                err, kind = compare(spark, con, fn, oracles[name], sf), "oracle"
            else:
                n = len(fn(spark, sf).collect())
                err, kind = (None if n else "no rows"), f"rows={n}"
        except Exception as e:  # report and go on
            err, kind = f"{type(e).__name__}: {str(e)[:900]}", "error"
        fails += err is not None
        print(f"{'FAIL' if err else 'ok  '} {name} [{kind}] {time.time() - t:.1f}s "
              f"{ {k: round(v, 1) for k, v in TIMES.items()} } {err or ''}", flush=True)
    print("failures:", fails)
