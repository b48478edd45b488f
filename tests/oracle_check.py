"""Compare every registered query with its SQL oracle.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int,)):
        return float(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    key = lambda r: tuple((v is None, str(type(v)), round(v, 3) if isinstance(v, float) else v) for v in r)
    return [columns[i] for i in order], sorted(out, key=key)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, query, sql, sf_dir):
    """(ok, message) for one query."""
    started = time.time()
    df = query(spark, sf_dir)
    got_cols, got = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    if sql is None:
        return True, f"rows-only {len(got)} rows {spent:.1f}s"
    started = time.time()
    cur = con.execute(sql)
    exp_cols, exp = _sorted_rows([d[0] for d in cur.description], cur.fetchall())
    spent_sql = time.time() - started
    if got_cols != exp_cols:
        return False, f"columns {got_cols} != {exp_cols}"
    if len(got) != len(exp):
        return False, f"rows {len(got)} != {len(exp)}"
    bad, drift = [], 0.0
    for g, e in zip(got, exp):
        for name, a, b in zip(got_cols, g, e):
            if a == b:
                continue
            if isinstance(a, float) and isinstance(b, float):
                drift = max(drift, abs(a - b) / max(1.0, abs(b)))
                if abs(a - b) <= 1e-9 * max(1.0, abs(b)):
                    continue
            bad.append((name, a, b))
    note = f"{len(got)} rows {spent:.1f}s sql {spent_sql:.1f}s drift {drift:.1e}"
    return not bad, note if not bad else f"{note}; {len(bad)} cells differ, e.g. {bad[:3]}"


def main(argv):
    import __spark_entry__ as entry
    from parcelspark.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name in argv[1:] or queries:
        chosen = [k for k in queries if k == name or k.startswith(name + "_")] or [name]
        for key in chosen:
            try:
                ok, note = compare(spark, con, queries[key], oracles.get(key), sf_dir)
            except Exception as exc:  # report and go on with the next query
                ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
            print(("ok   " if ok else "FAIL ") + key + "  " + note, flush=True)
            if not ok:
                failed.append(key)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
