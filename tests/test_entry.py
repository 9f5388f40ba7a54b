"""Registered queries run on the smallest tables, and their oracles agree."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from veilframe.plans import registry

SKIP_IN_SMOKE = {"scan_extractions"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con


def test_flagship(spark):
    assert entry.entry(spark).count() >= 1


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql())))
def test_oracle(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SKIP_IN_SMOKE))
def test_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() >= 0
