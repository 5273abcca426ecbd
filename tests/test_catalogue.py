"""Every query against its SQL on DuckDB, as bags of rows."""

import glob
import math
import os

import pytest

from tickforge.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool | str):
        return value
    if isinstance(value, int | float):
        return round(float(value), 6) + 0.0
    return str(value).replace("+00:00", "")


def bag(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    got = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    want, have = bag(columns, got.fetchall()), bag(df.columns, [tuple(r) for r in df.collect()])
    differing = [(a, b) for a, b in zip(have, want, strict=False) if a != b][:3]
    assert len(have) == len(want) and not differing, (len(have), len(want), differing)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0
