"""Run registered queries against their SQL on the supplied tables: ``python tests/oracle.py [names...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return str(int(number)) if number == int(number) else repr(number)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, folder, fn, sql):
    got = fn(spark, folder)
    plain = {"string", "bigint", "int", "double", "boolean"}
    odd = [c for c, kind in got.dtypes if kind not in plain]
    assert not odd, f"columns of other kinds: {odd}"
    cols, got_rows = rows_of(got.columns, [tuple(r) for r in got.collect()])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = con.execute(sql)
    want_cols, want_rows = rows_of([d[0] for d in cur.description], cur.fetchall())
    return cols, got_rows, want_cols, want_rows


def main(names):
    from __spark_entry__ import oracle_sql, queries
    from foldstone.session import local_session

    spark = local_session(8)
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    sqls, bad = oracle_sql(), []
    for name, fn in queries().items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            if name not in sqls:
                print(f"{name:42s} rows-only {fn(spark, folder).count()} {time.time() - start:.1f}s")
                continue
            cols, got, want_cols, want = compare(spark, folder, fn, sqls[name])
            ok = cols == want_cols and got == want
            print(f"{name:42s} {'OK ' if ok else 'BAD'} rows {len(got)}/{len(want)} {time.time() - start:.1f}s", flush=True)
            if not ok:
                bad.append(name)
                if cols != want_cols:
                    print("   columns", set(cols) ^ set(want_cols))
                else:
                    extra, missing = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
                    print("   cols ", cols, "\n   spark", extra, "\n   sql  ", missing, len(set(got) - set(want)))
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"{name:42s} ERR {str(error)[:1500]}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
