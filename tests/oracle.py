"""Compares a Spark result with DuckDB SQL over the same tables."""

import os

import duckdb
import pandas as pd


def check(spark, sf_dir, run, sql):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    want = con.execute(sql).df()
    got = run(spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns), (sorted(got.columns), sorted(want.columns))
    cols = sorted(got.columns)
    key = lambda r: str(r)
    a, b = sorted(plain_rows(got[cols]), key=key), sorted(plain_rows(want[cols]), key=key)
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b, strict=True):
        assert x == y, [(c, p, q) for c, p, q in zip(cols, x, y, strict=True) if p != q]


def plain_rows(df):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if hasattr(v, "isoformat"):
            return str(pd.Timestamp(v))
        if hasattr(v, "item"):
            v = v.item()
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return [tuple(one(v) for v in row) for row in df.itertuples(index=False, name=None)]
