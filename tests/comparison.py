"""Order-insensitive comparison of a Spark result with DuckDB's on the same tables."""

import glob
import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(map(plain, r)) for r in zip(*[table.column(n).to_pylist() for n in names], strict=True))


def same(spark_frame, con, sql):
    got_names, got = rows(spark_frame.toArrow())
    want_names, want = rows(con.execute(sql).to_arrow_table())
    assert got_names == want_names
    assert got == want
