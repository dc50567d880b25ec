"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from loomstat.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6) + 0.0
        elif df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]")
    df = df.astype(str).replace({"<NA>": "None", "nan": "None", "NaT": "None", "-0.0": "0.0"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, name):
    got = registry.queries()[name](spark, sf).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = c.execute(sql).df()
    a, b = norm(got), norm(want)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    assert a.equals(b), f"{a[(a != b).any(axis=1)].head()}\n{b[(a != b).any(axis=1)].head()}"
