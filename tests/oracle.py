"""Compare a query's rows with those of its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def rows_of(columns, rows):
    """Rows by name order of their columns, sorted by what is exact in them."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [[r[i] for i in order] for r in rows]
    return sorted(out, key=lambda r: ([str(x) for x in r if not isinstance(x, float)], [x for x in r if isinstance(x, float)]))


def same(a, b):
    """Doubles to a unit of the sixth decimal (engines sum in different orders), all else exactly."""
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def check(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == kinds
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    assert len(ours) == len(theirs)
    assert all(same(a, b) for x, y in zip(ours, theirs, strict=True) for a, b in zip(x, y, strict=True))
