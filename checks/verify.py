"""Run the checked queries beside their SQL and compare rows: python -m checks.verify [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from checks.queries import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(df, con, sql: str) -> str:
    """'' when rows and columns are equal, else what differs."""
    columns = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    kinds = {d[0]: str(d[1]) for d in res.description}
    order = [names.index(c) for c in columns]
    want = Counter(tuple(r[i] for i in order) for r in res.fetchall())
    if got != want:
        return f"rows {sum(got.values())} and {sum(want.values())}; only Spark {list((got - want).items())[:2]}; only SQL {list((want - got).items())[:2]}"
    alike = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN"}
    odd = {c: (t, kinds[c]) for c, t in df.dtypes if alike.get(t) != kinds[c]}
    return f"types {odd}" if odd else ""


def main(sf: str, names: list[str]) -> int:
    from vacantia.session import local_session

    spark, con, bad = local_session(8), oracle(sf), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf)
            problem = compare(df, con, ORACLES[name]) if name in ORACLES else f"no SQL, {df.count()} rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(problem)
        print(f"{name:34s} {time.time() - start:6.1f}s {problem or 'ok'}", flush=True)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(main(args[0] if args else "/root/testdata/sf0.01", args[1:]))
