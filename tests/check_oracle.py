"""Compare registered queries with their DuckDB twins on one scale factor.

Usage: python tests/check_oracle.py [sf_dir] [query ...]
"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def frames_equal(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty when both hold the same rows in any order, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    columns = sorted(got.columns)
    plain = lambda df: sorted(df[columns].astype(object).where(df[columns].notna(), None).map(str).itertuples(index=False, name=None))
    left, right = plain(got), plain(want)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} of {len(left)} rows differ, first {bad[0]}" if bad else ""


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


def schemas_differ(got: list[tuple[str, str]], want: list[tuple[str, str]]) -> str:
    """Empty when names, their order and the plain types agree. ``got``: Spark's dtypes; ``want``: DuckDB's names and types."""
    if [n for n, _ in got] != [n for n, _ in want]:
        return f"columns {[n for n, _ in got]} != {[n for n, _ in want]}"
    bad = [(n, a, b) for (n, a), (_, b) in zip(got, want) if a in TYPES and TYPES[a] != b]
    return f"types {bad}" if bad else ""


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from revmatch.session import build_session

    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "10g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    sql = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if (name not in names) if names else (name not in sql):
            continue
        start = time.time()
        try:
            result = fn(spark, sf_dir)
            got = result.toPandas()
            took = time.time() - start
            if name in sql:
                described = [(r[0], r[1]) for r in con.execute(f"describe {sql[name]}").fetchall()]
                problem = frames_equal(got, con.execute(sql[name]).df()) or schemas_differ(result.dtypes, described)
            else:
                problem = "no twin"
        except Exception as error:
            got, took, problem = [], time.time() - start, f"{type(error).__name__}: {str(error)[:300]}"
        failed += bool(problem)
        print(f"{name:26s} {len(got):8d} rows {took:6.1f}s  {problem or 'ok'}"[:400], flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(main(folder, sys.argv[2:]) > 0)
