"""Run registered queries beside their SQL twins and compare all values.

``python -m tests.oracle [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def _rows(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in at) for r in rows]
    return [columns[i] for i in at], sorted(plain, key=repr)


def compare(spark, con, sf_dir: str, fn, sql: str | None) -> str:
    """Empty if both sides agree, else what differs first."""
    df = fn(spark, sf_dir)
    names, mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if mine else "no rows"
    cur = con.execute(sql)
    names2, theirs = _rows([c[0] for c in cur.description], cur.fetchall())
    if names != names2:
        return f"columns {names} != {names2}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"values\n  spark {str(a)[:600]}\n  sql   {str(b)[:600]}"
    return "" if mine else "no rows"


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from newsloom.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if args and not any(name == a or name.startswith(a + "_") for a in args):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, fn, oracles.get(name))
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(problem)
        kind = "sql " if name in oracles else "rows"
        print(f"{'BAD' if problem else 'ok '} {kind} {time.time() - start:6.2f}s {name} {problem}", flush=True)
    print(f"{bad} bad of {len(queries)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
