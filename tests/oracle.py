"""Spark's rows against DuckDB's, columns by name and rows in any order."""

import glob
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def rows(table):
    cols = sorted(table.schema.names)
    return sorted(zip(*(table.column(c).to_pylist() for c in cols), strict=True), key=repr), cols


def compare(spark, con, sf, f, sql):
    got, cols = rows(f(spark, sf).toArrow())
    want, names = rows(con.execute(sql).to_arrow_table())
    assert cols == names, (cols, names)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, (len(bad), bad[:3])
    return len(got)
