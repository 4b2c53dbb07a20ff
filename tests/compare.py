"""Run registered queries next to their SQL and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (bool, str)) or v is None:
        return repr(v)
    return str(v)


def normalized(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def differences(spark, con, name, fn, sql, sf_dir, limit=4):
    """Text of what differs, empty when both agree in names, types of values and rows."""
    df = fn(spark, sf_dir)
    mine = normalized(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    theirs = normalized([d[0] for d in result.description], result.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} against {theirs[0]}"
    if mine[1] == theirs[1]:
        return ""
    left, right = set(mine[1]), set(theirs[1])
    extra, lacking = sorted(left - right)[:limit], sorted(right - left)[:limit]
    return f"{len(mine[1])} rows against {len(theirs[1])}\n   only Spark {extra}\n   only SQL {lacking}"


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from canvass.session import local_session

    spark, con = local_session(), oracle_connection(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert not set(oracle) - set(queries), set(oracle) - set(queries)
    bad = 0
    for name, fn in queries.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracle:
                problem = differences(spark, con, name, fn, oracle[name], sf_dir)
                state = "ok" if not problem else "DIFFERS " + problem
            else:
                problem, state = "", f"rows {fn(spark, sf_dir).count()}"
        except Exception as e:  # report every query, then fail at the end
            problem, state = "error", f"ERROR {type(e).__name__} {str(e)[:600]}"
        bad += bool(problem)
        print(f"{name:32s} {time.time() - start:6.2f}s  {state}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
