"""Run catalog queries on Spark and DuckDB and compare them: python tests/oracle.py SF [key ...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _rows(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


# Type families whose values look alike in both engines.
_SPARK_KIND = {
    "bigint": "int", "int": "int", "double": "float", "string": "text", "boolean": "bool",
    "date": "date", "timestamp_ntz": "ts",
}
_DUCK_KIND = {
    "BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "text", "BOOLEAN": "bool",
    "DATE": "date", "TIMESTAMP": "ts",
}


def compare(spark, con, sf_dir: str, build, sql: str) -> str | None:
    """None when both results agree, else what differs."""
    got = build(spark, sf_dir)
    kinds = {n: _SPARK_KIND.get(t, t) for n, t in got.dtypes}
    got_rows = _rows(got.columns, got.collect())
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want_kinds = {d[0]: _DUCK_KIND.get(str(d[1]), str(d[1])) for d in cur.description}
    want_rows = _rows(want_names, cur.fetchall())
    if kinds != want_kinds:
        return f"columns differ: {sorted(kinds.items())} / {sorted(want_kinds.items())}"
    if len(got_rows) != len(want_rows):
        return f"row counts differ: {len(got_rows)} / {len(want_rows)}"
    for a, b in zip(got_rows, want_rows):
        if a != b:
            return f"first difference: {str(a)[:500]} / {str(b)[:500]}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, keys = f"/root/testdata/sf{sys.argv[1]}", sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if keys and name not in keys:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, build, sql[name])
            n = con.execute(f"select count(*) from ({sql[name]})").fetchall()[0][0]
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {str(error)[:600]}", -1
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} rows={n} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
