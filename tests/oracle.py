"""Compares a query with its DuckDB SQL on the same Parquet tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row):
    return tuple("" if v is None else f"{v:.5g}" if isinstance(v, float) else str(v) for v in row)


def assert_equal(df, con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(([tuple(r) for r in found.fetchall()]), key=_key)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=_key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y, n in zip(a, b, names, strict=True):
            same = (x is None and y is None) or (isinstance(x, float) and y is not None and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)) or x == y
            assert same, (n, x, y, a, b)
