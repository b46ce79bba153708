"""Runs registered queries against their SQL form in DuckDB: python tests/compare.py [sf_dir] [query…]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def rows_of(records, columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in records), key=repr)


def difference(spark, con, name: str, sf_dir: str) -> str | None:
    """None if the query and its SQL give the same columns, types of integers included, and rows."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.collect(), df.columns)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = rows_of(cursor.fetchall(), columns)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    types = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    sql_types = {d[0]: str(d[1]) for d in cursor.description}
    kinds = con.execute(f"describe {entry.oracle_sql()[name]}").fetchall()
    sql_types = {k[0]: k[1] for k in kinds}
    for c, t in df.dtypes:
        if types.get(t, t) != sql_types[c]:
            return f"type of {c}: {t} != {sql_types[c]}"
    if got != want:
        first = next((i for i, (a, b) in enumerate(zip(got, want)) if a != b), min(len(got), len(want)))
        return f"{len(got)} rows != {len(want)} rows; at {first}: {got[first:first + 2]} != {want[first:first + 2]}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from loglens.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = difference(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print(f"{len(names)} queries, {failed} failed")


if __name__ == "__main__":
    main()
