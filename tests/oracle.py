"""Compare registered queries with their SQL on the same Parquet files.

Usage: python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value: object) -> object:
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0 if value else 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return str({k: plain(v) for k, v in value.items()})
    if isinstance(value, int):
        return repr(int(value))
    return str(value)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(plain(row[i])) for i in order) for row in rows)


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when columns and rows agree, else a short report."""
    cur = con.execute(sql)
    duck_cols = [d[0] for d in cur.description]
    duck = rows_of(duck_cols, cur.fetchall())
    spark = rows_of(spark_df.columns, spark_df.collect())
    if sorted(duck_cols) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(duck_cols)}"
    if spark == duck:
        return None
    ours, theirs = set(spark), set(duck)
    text = lambda rows: "\n    ".join(str(r)[:900] for r in sorted(rows)[:2])
    return f"rows {len(spark)} vs {len(duck)}; only spark {len(ours - theirs)}:\n    {text(ours - theirs)}\n  only sql {len(theirs - ours)}:\n    {text(theirs - ours)}"


def main() -> None:
    from clipmetrics.plans import catalogue
    from clipmetrics.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(catalogue.queries())
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(sf_dir), catalogue.queries(), catalogue.oracle_sql()
    bad = []
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            report = difference(df, con, oracles[name]) if name in oracles else f"(rows only: {len(df.collect())})"
        except Exception as error:  # report and go on with the next query
            report = f"{type(error).__name__}: {str(error)[:1500]}"
        took = time.time() - start
        ok = report is None or report.startswith("(rows only")
        print(f"{'ok  ' if ok else 'FAIL'} {name} {took:.1f}s {'' if report is None else report}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} agree; failing: {bad}")


if __name__ == "__main__":
    main()
