"""Run every registered query next to its SQL twin: ``python tests/check.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from conftest import session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(r[i] for i in order) for r in rows], key=repr)


KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, con, name, sf_dir):
    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got), "rows only"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return len(got), f"COLUMNS {sorted(df.columns)} != {sorted(names)}"
    bad = [(c, t, types[c]) for c, t in df.dtypes if KINDS.get(t) != types[c]]
    if bad:
        return len(got), f"TYPES {bad}"
    a, b = canon(got, df.columns), canon(want, names)
    if a != b:
        off = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        n_off = sum(x != y for x, y in zip(a, b))
        return len(got), f"VALUES {len(a)} vs {len(b)} rows, {n_off} differ\n   {a[off:off+1]}\n   {b[off:off+1]}"
    return len(got), "ok"


if __name__ == "__main__":
    args = sys.argv[1:]
    sf_dir = f"/root/testdata/sf{args[0] if args else '0.01'}"
    spark, con = session(), oracle(sf_dir)
    names = args[1:] or list(entry.queries())
    failed = 0
    for name in names:
        t0 = time.time()
        try:
            rows, verdict = compare(spark, con, name, sf_dir)
        except Exception as exc:  # report and go on with the next query
            rows, verdict = -1, f"ERROR {str(exc)[:600]}"
        failed += not verdict.startswith(("ok", "rows"))
        print(f"{name:32s} {rows:8d} {time.time() - t0:6.2f}s {verdict}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    sys.exit(bool(failed))
