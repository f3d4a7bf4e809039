"""Compare registered queries with their SQL: ``python tests/check_queries.py SF [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if hasattr(value, "quantize"):
        return round(float(value), 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name, query, sql) -> str | None:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return None
    extra = [r for r in got[1] if r not in set(want[1])][:2]
    missing = [r for r in want[1] if r not in set(got[1])][:2]
    return f"{len(got[1])} rows against {len(want[1])}\n   spark {extra}\n   sql   {missing}"


def main() -> None:
    import __spark_entry__ as entry
    from newsloom.session import build

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:] or list(entry.queries())
    spark = build("local[8]", **{"spark__sql__shuffle__partitions": "8", "spark__ui__enabled": "false", "spark__ui__showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        sql = entry.oracle_sql().get(name)
        try:
            if sql is None:
                n = entry.queries()[name](spark, sf_dir).count()
                verdict = f"rows only: {n}"
            else:
                verdict = compare(spark, con, sf_dir, name, entry.queries()[name], sql)
        except Exception as error:  # noqa: BLE001
            verdict = f"{type(error).__name__}: {str(error).strip()[:300]}"
        bad += verdict is not None and not verdict.startswith("rows only")
        print(f"{name:28s} {time.time() - start:6.1f}s  {verdict or 'ok'}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
